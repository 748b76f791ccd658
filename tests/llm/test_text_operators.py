"""Operators on texts against brute force, and their rows for odd input."""

import hashlib
import itertools
import re
import textwrap
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from graphloom.llm import components, decontaminate, labelled, license_scan, ngram_join, packing, quality, queries, secret_scan, suffix_dedup, token_rollup, toxicity
from tests.llm.conftest import LONG, ODD

SEED = np.random.default_rng(3)
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


# --- secrets


def naive_base(text):
    kinds = [
        ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def test_base_secrets_equal_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_secret_scans(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = naive_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == [f"{k}:{a}:{b}" for k, a, b in want]


@settings(max_examples=60, deadline=None)
@given(some.text(alphabet="abcdefgh0123XYZ+/", min_size=0, max_size=70), some.integers(8, 20))
def test_entropy_windows_equal_recounting(text, window):
    least = 2.5
    inside = set()
    for i in range(len(text) - window + 1):
        part = text[i : i + window]
        h = -sum(part.count(c) / window * np.log2(part.count(c) / window) for c in set(part))
        if h >= least - 1e-11:
            inside |= set(range(i, i + window))
    got = secret_scan.entropy_windows(text, window, least)
    assert set(itertools.chain(*(range(a, b) for a, b in got))) == inside


def test_entropy_secret_is_found_and_known_forms_are_not():
    key = "q8Zr2Lw0Xk7Vb4Tn9Yc3Jd6Hf1Gs5Pm"
    assert [k for _, k, _ in secret_scan.find_secrets(f"key {key} end")] == [3]
    for s in ("123e4567-e89b-12d3-a456-426614174000", "internationalisation", "some_long/path/of/words/here", "=" * 40, "2024-01-01/2024-12-31+100000"):
        assert secret_scan.find_secrets(f"x {s} y") == []
    assert key not in secret_scan.redact(f"a {key} b")


@settings(max_examples=150, deadline=None)
@given(some.text(alphabet="ab=-_+", min_size=1, max_size=9))
def test_rulers_equal_the_pattern(text):
    assert (len(set(text.strip("+/_=-"))) <= 1) == bool(re.fullmatch(r"[+/_=-]*(.)\1*[+/_=-]*", text))


def test_long_runs_take_linear_time():
    many = " ".join(f"token={i:08d}abcd q8Zr2Lw0Xk7Vb4Tn9Yc3Jd6Hf1Gs5P{i}" for i in range(3_000))
    for text in ("=" * 1_000_000 + "ab", "-" * 1_000_000, "0123456789abcdef" * 30_000, "Ab9/" * 60_000, "ab_" * 100_000 + "!", "password" + " " * 1_000_000, "a-b" * 100_000, many):
        began = time.process_time()
        secret_scan.find_secrets(text)
        assert time.process_time() - began < 5, text[:40]


# --- n-gram join


def naive_components(pairs, k, percent):
    sets = {}
    for i, t in pairs:
        sets.setdefault(i, []).append(shingles(t, k))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_components_equal_all_pairs(spark, docs_of, k, percent):
    base = [list(SEED.choice([f"w{i}" for i in range(40)], SEED.integers(3, 60))) for _ in range(25)]
    pairs = []
    for i, b in enumerate(base):
        for c in range(int(SEED.integers(1, 6))):
            w = list(b)
            for _ in range(int(SEED.integers(0, 3))):
                w[int(SEED.integers(0, len(w)))] = "changed"
            pairs.append((100 * i + c, "  ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(pairs), k, percent).collect()}
    want = naive_components(pairs, k, percent)
    assert got == {i: (len(shingles(t, k)), want[i]) for i, t in pairs}


def test_ids_that_stand_for_several_texts_have_the_links_of_all(spark, docs_of):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abcd"}
    near = {c: t.replace(f"{c}39", "changed") for c, t in text.items()}
    pairs = [(1, text["a"]), (1, text["b"]), (1, text["c"]), (2, near["a"]), (3, near["b"]), (4, near["c"]), (4, text["d"]), (5, near["d"]), (5, near["d"]), (6, "one two"), (7, ""), (1, None), (8, "other words " * 20)]
    got = ngram_join.ngram_components(docs_of(pairs)).collect()
    assert len(got) == len(pairs)
    want = naive_components(pairs, 5, 80)
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) and {r.component_id for r in got} == {1, 6, 7, 8}


def test_group_whose_copies_link_only_through_their_source(spark, docs_of):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    pairs = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for j in rng.choice(12, 2, replace=False):  # two words of the source are changed, so two copies share less than the limit
            w[10 * int(j) + int(rng.integers(0, 4))] = f"e{i}x{j}"
        pairs.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(pairs), 5, 80).collect()}
    assert got == naive_components(pairs, 5, 80)


def test_components_of_a_path(spark):
    path = [(i + 1, i) for i in range(300)] + [(None, 3), (5, 5), (1001, 1000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[1001] == got[1000] == 1000


# --- repeated bytes


def naive_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = {}
    for d in data:
        for i in range(len(d) - length + 1):
            count[d[i : i + length]] = count.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] > gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_equal_brute_force(spark, docs_of, hot):
    letters = np.array(list("abcdé "))
    make = lambda n: "".join(SEED.choice(letters, n))
    shared = [make(n) for n in (38, 45, 60, 150)]
    texts = [None, "", "short", "x" * 500, "x" * 20 + make(80), make(5_000)]
    for _ in range(30):
        texts.append("".join(make(int(SEED.integers(0, 70))) + shared[int(SEED.integers(0, 4))] for _ in range(int(SEED.integers(0, 4)))))
    texts += [texts[6], texts[6], "ab" * 90, "ab" * 45 + "é" + "ab" * 30]
    pairs = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs_of(pairs), 40, hot).collect()}
    assert got == dict(enumerate(naive_removed(texts, 40)))
    kept = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup.kept_texts(docs_of(pairs), 40, hot).collect()}
    assert kept == {i: x[3] for i, x in got.items()}


def test_repeats_equal_brute_force_on_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_array_dedup(spark, sf).collect()}
    assert got == dict(zip(texts, naive_removed(list(texts.values()), 400), strict=True))


# --- packing


def test_packing_holds_the_tokens_of_the_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_best_fit_packing(spark, sf).toPandas().sort_values(["doc_id", "piece"])
    for doc_id, mine in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in mine.itertuples():
            assert r.start == at and zlib.crc32(ids[at : at + r.length]) == r.ids_crc32 and 0 < r.length <= 1024
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(mine) == 1)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate([[0], np.cumsum(s["length"])[:-1]])).all() and s["length"].sum() <= 1024
    assert set(got["doc_id"]) == set(texts)
    assert got["sequence_id"].nunique() <= 1.02 * np.ceil(got["length"].sum() / 1024) + 1


@settings(max_examples=30, deadline=None)
@given(some.dictionaries(some.integers(1, 16), some.integers(1, 400), max_size=16))
def test_plan_covers_the_histogram(histogram):
    held = np.zeros(17, np.int64)
    for filling, times in packing.plan(histogram, 16):
        assert (filling * np.arange(17)).sum() <= 16 and times > 0
        held += filling * times
    assert {i: int(n) for i, n in enumerate(held) if n} == histogram


def test_plan_of_all_lengths_takes_hardly_more_than_the_volume():
    histogram = dict.fromkeys(range(1, 1024), 90)
    assert sum(times for _, times in packing.plan(histogram, 1024)) <= 1.005 * 90 * sum(range(1, 1024)) / 1024


def test_plan_beats_best_fit_where_best_fit_is_not_optimal():
    demand = np.zeros(1001, np.int64)
    demand[[510, 270, 260, 230]] = 600, 600, 600, 1200
    rounds, left, low = packing.covering(demand, 1000)
    assert 899.9 < low < 900.1 and (sum(c * times for taken in rounds for c, times in taken) + left == demand).all()
    assert sum(times for _, times in packing.best_fit(demand.copy(), 1000)) > 1000
    assert sum(times for _, times in packing.plan({int(i): int(demand[i]) for i in np.flatnonzero(demand)}, 1000)) <= 902


def test_multiplicative_weights_cover_most_pieces_of_real_lengths(spark):
    """Most sequences come from the program, and with the rest there are hardly more than must be."""
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    demand = np.zeros(1025, np.int64)
    for r in cut.groupBy("length").count().collect():
        demand[r.length] = r["count"] if r.length < 1024 else 0
    rounds, left, low = packing.covering(demand, 1024)
    assert left.sum() <= 0.35 * demand.sum()
    assert sum(t for _, t in packing.rounded(rounds, demand, 1024)) <= 1.005 * low + 2


def test_packing_ids_of_special_tokens_and_long_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), packing.load_tokenizer(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    rng = np.random.default_rng(4)
    mixed = ["".join(rng.choice(list("aé中 \n\t'0😀<|>"), 200)) + "<|endoftext|>" * (i % 3) for i in range(60)]
    for text in [*mixed, " " * 49_000 + "x", "\n \t" * 16_000, "ab" * 20_000, "word " * 15_000]:
        assert ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    for text in (" " * 1_000_000, "a" * 1_000_000):
        assert len(ids(text))


# --- classifiers


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.95), ("op3_quality_classifier", "quality", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    got = queries.queries()[name](spark, sf).toPandas()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(got) == n and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both["held_out"] & both[label].notna()]
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) >= least


def test_quality_scores_equal_recomputed_sizes(spark, sf):
    """Sizes, difference and score of every text again, by the plain compressor and the model's numbers."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = {"level": quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    each = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[x]), **plain) for x in ("good", "bad")] + [zstandard.ZstdCompressor(**plain)]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = quality.score(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        good, bad, alone = (sum(len(c.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)) for c in each)
        want = 1 / (1 + np.exp(-(model["weights"][0] + model["weights"][1] * (bad - good) / alone))) if data else model["prior"]
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.3)


def test_quality_learns_from_whole_texts_and_bounds_repeated_ids(spark, docs_of, labels_of):
    rng = np.random.default_rng(2)
    say = lambda stem, n: "\n".join(" ".join(f"{stem}{i}" for i in rng.integers(0, 60, 12)) for _ in range(n))
    alike = [say("same", 150) for _ in range(60)]  # some 9,000 characters before the part that tells the classes apart
    pairs = [(i, t + "\n" + say("good" if i % 2 else "bad", 25)) for i, t in enumerate(alike)]
    docs, labels = docs_of(pairs + [pairs[3]] * 200), labels_of([(i, i % 2, 0) for i, _ in pairs])
    got = quality.score(docs, quality.fit(docs, labels)).toPandas().drop_duplicates("doc_id")
    assert auc(got["score"].to_numpy(), got["doc_id"].to_numpy() % 2) > 0.95
    assert labelled.sample(docs, labels, "quality", 100).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in pairs)


@settings(max_examples=80, deadline=None)
@given(some.lists(some.integers(-5, 5), max_size=24))
def test_segments_equal_repeated_best_segment(values):
    """The maximal segments are those found by taking the best segment again and again on either side."""

    def best(lo, hi):
        found = max(((sum(values[a:b]), a - b, -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if found[0] <= 0:
            return []
        a = -found[2]
        b = a - found[1]
        return best(lo, a) + [(a, b, found[0])] + best(b, hi)

    got = toxicity.maximal_segments(np.array(values, float))
    want = best(0, len(values))
    assert sum(x[2] for x in got) == sum(x[2] for x in want) and max((x[2] for x in got), default=0) == max((x[2] for x in want), default=0)


def test_token_odds_equal_recounted_contexts(spark, docs_of, labels_of):
    """Log-odds with the Dirichlet prior from plain sets of (token, token before), for every token kept."""
    rng = np.random.default_rng(9)
    pairs = [(i, " ".join(rng.choice([f"{'t' if i % 2 and rng.random() < 0.5 else 'c'}{j}" for j in range(30)], 40))) for i in range(200)]
    model = toxicity.fit(docs_of(pairs), labels_of([(i, 1, i % 2) for i, _ in pairs]))
    learned = [(i, t) for i, t in pairs if zlib.crc32(str(i).encode()) % 5]
    seen = {label: {(b, a) for i, t in learned if i % 2 == label for a, b in zip([None, *t.split()], t.split(), strict=False)} for label in (0, 1)}
    count = lambda label, w: sum(x == w for x, _ in seen[label])
    n1, n0 = len(seen[1]), len(seen[0])
    a0 = max(1.0, toxicity.PRIOR * (n1 + n0))
    kept = dict(zip(model["hashes"].tolist(), model["scores"].tolist(), strict=True))
    hits = 0
    for w in sorted({w for label in seen for w, _ in seen[label]}):
        alpha = (count(0, w) + count(1, w)) * a0 / (n1 + n0)
        y1, y0 = count(1, w) + alpha, count(0, w) + alpha
        d = np.log(y1 / (n1 + a0 - y1)) - np.log(y0 / (n0 + a0 - y0))
        h = int(toxicity.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])
        if abs(d / np.sqrt(1 / y1 + 1 / y0)) >= toxicity.LEAST_Z + 1e-9:
            assert abs(kept[h] - (d - toxicity.DRIFT)) < 1e-9
            hits += 1
        else:
            assert h not in kept
    assert hits > 10


def test_toxic_passages_lie_in_the_toxic_part(spark, docs_of, labels_of):
    rng = np.random.default_rng(1)
    clean = [f"c{i}" for i in range(200)]
    bad = [f"t{i}" for i in range(20)]
    text = lambda toxic: " ".join([*rng.choice(clean, 60), *rng.choice(bad if toxic else clean, 25), *rng.choice(clean, 60)])
    pairs = [(i, text(i % 2)) for i in range(600)]
    model = toxicity.fit(docs_of(pairs), labels_of([(i, 1, i % 2) for i, _ in pairs]))
    found = toxicity.passages(docs_of(pairs), model).toPandas()
    assert set(found["doc_id"]) == {i for i, _ in pairs if i % 2} and (found["start"] >= 55).all() and (found["end"] <= 90).all()


# --- decontamination


def test_contained_items_equal_brute_force(spark, docs_of):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 40))))) for i in range(40)]
    pairs = []
    for i in range(120):
        w = list(rng.choice(vocabulary, 80))
        part = words(items[int(rng.integers(0, 40))][1])
        part = part[: max(1, len(part) * int(rng.integers(60, 101)) // 100)]
        pairs.append((i, " ".join(w[:30] + part + w[30:])))
    table = spark.createDataFrame([(*x, "x") for x in [*items, (None, "a b"), (90, None), (91, "")]], "item_id long, text string, n string")
    short = [(60 + i, " ".join(words(pairs[i][1])[7 : 8 + i])) for i in range(4)] + [(70, "v1 never v2"), (71, words(pairs[9][1])[0])]
    table = table.unionByName(spark.createDataFrame([(*x, "x") for x in short], table.schema))
    items += short
    pairs += [(200, "v1"), (201, short[2][1]), (202, "")]
    want = set()
    for i, y in items:
        k = min(5, len(words(y)))  # an item of fewer words is a run of its own length
        s = shingles(y, k)
        for d, x in pairs:
            held = s & shingles(x, k) if len(words(x)) >= k else set()
            if 100 * len(held) >= 80 * len(s):
                want.add((d, i, len(held), len(s)))
    assert {i for _, i, _, _ in want} >= {60, 61, 62, 63, 71}
    for block in (decontaminate.BLOCK, 100):
        got = decontaminate.contained_items(docs_of(pairs), table, 5, 80, block).collect()
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)


# --- rollup


def test_rollup_of_changes(spark, tmp_path):
    roll = token_rollup.Rollup(spark, str(tmp_path))
    batch = lambda *rows: spark.createDataFrame(rows, "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long, seq int")
    state = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
    assert state() == {}
    first = batch(("insert", 1, "t", "a", "en", 10, 0), ("insert", 2, "t", "a", "en", 5, 0), ("insert", 3, "t", None, "en", None, 0), ("insert", None, "t", "a", "en", 9, 0))
    assert roll.commit("1", first) and not roll.commit("1", first)
    assert state() == {("a", "en"): (2, 15), (None, "en"): (1, 0)}
    roll.commit("2", batch(("delete", 2, "t", None, None, None, 0), ("revise", 1, "t", "b", "en", 12, 0), ("revise", 1, "t", "b", "en", 11, 1), ("delete", 77, "t", "a", "en", 1, 0)))
    assert state() == {("b", "en"): (1, 11), (None, "en"): (1, 0)}
    roll.commit("3", batch(("insert", 1, "t", "b", "en", 4, 0)))
    assert state() == {("b", "en"): (1, 4), (None, "en"): (1, 0)}
    roll.compact(str(tmp_path / "new"))
    again = token_rollup.Rollup(spark, str(tmp_path / "new"))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in again.totals().collect()} == state()


def test_rollup_batch_that_was_cut_short_is_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([("insert", 1, "t", "a", "en", 10, 0)], "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long, seq int")
    rows.limit(0).selectExpr("doc_id", "tokenizer", "source", "lang", "n_tokens", "cast(1 as long) as sign").write.parquet(f"{tmp_path}/ledger/batch=1")
    roll = token_rollup.Rollup(spark, str(tmp_path))
    assert roll.totals().count() == 0 and roll.commit("1", rows) and roll.totals().first().n_tokens == 10


def test_token_counts_equal_plain_counts(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counters = {"words_v1": lambda t: len([w for w in SPACE.split(t) if w]), "bytes_v1": lambda t: len(t.encode()), "byte_bpe_50k": lambda t: len(whole.encode(t, add_special_tokens=False).ids)}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for name, count in counters.items():
            if n := count(r.text or ""):
                docs, tokens = want.get((r.source, r.lang, name), (0, 0))
                want[r.source, r.lang, name] = docs + 1, tokens + n
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in queries.op4_token_counts(spark, sf).collect()} == want


# --- licences


def test_license_rules(docs_of):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: \nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. Some other thing. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    got = {r.doc_id: (r.licenses, r.n_matches, r.n_known, r.n_left) for r in license_scan.scan(docs_of([(1, mit), (2, "All rights reserved. Released under the MIT license!\nAll rights reserved"), (3, "See the license for the specific language governing permissions and limitations under the license."), (4, None)])).collect()}
    assert got == {1: ("MIT-text", 1, 3, 0), 2: ("MIT,All-rights-reserved", 3, 3, 0), 3: ("", 0, 1, 1), 4: ("", 0, 0, 0)}


# --- odd and empty tables, for every operator


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""


def test_wrapped_license_headers(docs_of):
    wrapped = [(APACHE, "Apache-2.0-header", 5), (GPL, "GPL-3.0-or-later-header", 3), (BSD, "BSD-2-Clause-text", 3), ("All rights\nreserved.", "All-rights-reserved", 1)]
    wrapped.append(("\n\n".join(textwrap.fill(license_scan.SENTENCES[i].capitalize() + ".", 70) for i in (5, 6, 7)), "MIT-text", 3))
    texts = [(mark.join(["Some code", *t.split("\n"), "more code"]), name, n) for t, name, n in wrapped for mark in ("\n", "\r\n", "\n * ", "\n# ", "\n// ", "\ndnl ")]
    got = {r.doc_id: r for r in license_scan.scan(docs_of(list(enumerate(t for t, _, _ in texts)))).collect()}
    for i, (text, name, n) in enumerate(texts):
        assert (got[i].licenses, got[i].n_matches, got[i].n_known, got[i].n_left) == (name, 1, n, int(name == "Apache-2.0-header")), text  # no rule takes its last sentence


def test_every_known_sentence_passes_the_hint(docs_of):
    got = license_scan.scan(docs_of(list(enumerate(license_scan.SENTENCES)))).collect()
    assert [r.n_known for r in got] == [1] * len(license_scan.SENTENCES)


def runs(spark, docs, labels, items, tmp):
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return {
        "secrets": lambda: secret_scan.scan(docs),
        "redacted": lambda: secret_scan.redacted(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
        "passages": lambda: toxicity.passages(docs, toxicity.fit(docs, labels)),
        "quality": lambda: quality.score(docs, quality.fit(docs, labels)),
        "accepted": lambda: quality.accepted(docs, quality.fit(docs, labels)),
        "rollup": lambda: token_rollup.rollup_documents(docs, tmp),
        "join": lambda: ngram_join.ngram_components(docs),
        "license": lambda: license_scan.scan(docs),
        "repeats": lambda: suffix_dedup.remove_repeats(docs),
        "kept": lambda: suffix_dedup.kept_texts(docs),
        "packing": lambda: packing.pack(docs, *paths),
        "items": lambda: decontaminate.contained_items(docs, items),
    }


NAMES = ("secrets", "redacted", "toxicity", "passages", "quality", "accepted", "rollup", "join", "license", "repeats", "kept", "packing", "items")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs_of, labels_of, tmp_path, name):
    docs, labels = docs_of(ODD), labels_of([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (4, None, None), (4, 7, 7), (5, 0, 0)])
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x")], "item_id long, text string")
    got = runs(spark, docs, labels, items, str(tmp_path))[name]().collect()
    if name in ("secrets", "redacted", "toxicity", "quality", "join", "license", "repeats", "kept"):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ODD)
    if name == "join":
        ids = {r.doc_id: r.component_id for r in got}
        assert ids == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, None: None, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9}
        assert {r.doc_id: r.n_shingles for r in got}[1] == 0
    if name == "repeats":
        assert {r.doc_id: r.n_removed for r in got}[6] == len(LONG)
    if name == "items":
        assert [(r.doc_id, r.item_id) for r in got] == [(None, 1)]
    if name == "packing":
        assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs_of, labels_of, tmp_path, name):
    docs, items = docs_of(ODD).limit(0), spark.createDataFrame([], "item_id long, text string")
    assert runs(spark, docs, labels_of([]), items, str(tmp_path))[name]().count() == 0


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_labels_of_one_class_or_none(spark, docs_of, labels_of, kind):
    model = toxicity if kind == "toxicity" else quality
    docs = docs_of([(i, f"text number {i} of some length") for i in range(40)])
    for rows in ([], [(i, 1, 1) for i in range(40)]):
        got = model.score(docs, model.fit(docs, labels_of(rows))).toPandas()
        assert len(got) == 40 and got["score"].between(0, 1).all() and got["score"].nunique() == 1


def test_held_out_is_the_crc_of_the_text(spark):
    got = spark.range(200).select("id", labelled.held_out("id").alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(r.id).encode()) % 5 == 0 for r in got]
