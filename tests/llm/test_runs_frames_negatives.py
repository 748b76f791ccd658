"""Periodic runs, token frames and hard negatives against brute force, exact round trips and odd rows."""

import hashlib
import io
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as some
from tokenizers import Tokenizer

from graphloom.llm import hard_negatives, periodic_runs, queries, token_frames
from graphloom.llm.store import table_path
from tests.llm.conftest import LONG, ODD

# --- periodic runs


def naive_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(some.lists(some.tuples(some.lists(some.integers(0, 2), min_size=1, max_size=12), some.integers(1, 7)), max_size=7), some.sampled_from([6, 9, 12, 24]))
def test_runs_of_a_sequence_equal_brute_force(parts, least):
    word = np.array([x for block, times in parts for x in block * times], np.int64)
    assert periodic_runs.runs_of(word, least) == naive_runs(word.tolist(), least)


def test_ordered_sets_keep_their_order_over_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    rng, seen = np.random.default_rng(1), {50}
    held = periodic_runs.EndPositions(50)
    for x in rng.permutation(200).tolist():
        if x != 50:
            before, after = held.add(x)
            assert before == max((y for y in seen if y < x), default=None) and after == min((y for y in seen if y > x), default=None)
            seen.add(x)
    assert list(held) == sorted(seen, reverse=True) and held.size == 200


def words_read(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_op11_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, seen = {r.doc_id: r for r in queries.op11_periodic_run_detection(spark, sf).collect()}, 0
    assert set(got) == set(texts)
    for i, text in texts.items():
        w, r = words_read(i, text, True), got[i]
        if len(w) > 2_500:
            continue  # too many for brute force
        runs = naive_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_runs_of_odd_rows(spark, docs_of):
    pairs = [*ODD, (11, "a b " * 20 + "c"), (12, "x " * 23), (13, "A a " * 12), (14, "p q r\n" * 9 + "p q s " * 8)]
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in periodic_runs.periodic_runs(docs_of(pairs)).collect())
    want = []
    for i, t in pairs:
        w = words_read(i, t, False)
        runs = [(0, 60_000, 1)] if t == LONG else naive_runs(w)
        want.append((str(i), runs, collapsed(w, runs), len(w)))
    assert got == sorted(want)
    empty = periodic_runs.periodic_runs(docs_of(pairs).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs_of(pairs), times=2)


# --- token frames


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_op12_equals_the_tokenizer(spark, sf, paths):
    encode, at = Tokenizer.from_file(paths[0]).encode, 0
    got = queries.op12_token_id_output(spark, sf).orderBy("doc_id").collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for g, r in zip(got, rows, strict=True):
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("per_frame", [7, 65_536])
def test_frames_of_odd_rows(spark, docs_of, paths, per_frame):
    encode = Tokenizer.from_file(paths[0]).encode
    docs = docs_of([p for p in ODD if p[1] is not LONG] + [(6, "word " * 2_000), (-4, "below zero")])
    files = token_frames.write_tokens(docs, table_path(spark, "tokens"), *paths, per_frame=per_frame)
    ids = {(r.doc_id, r.text): [*encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    want = sorted((str(r.doc_id), ids[r.doc_id, r.text]) for r in docs.collect())
    got = token_frames.read_tokens(files).collect()
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    wanted = spark.createDataFrame([(5,), (6,), (5,), (999,), (-4,), (None,)], "doc_id long")
    found = token_frames.find_tokens(files, wanted).collect()
    assert sorted(r.doc_id for r in found) == [-4, 5, 5, 6]
    places = {(r.doc_id, r.start): r.ids for r in got}
    assert all(places[r.doc_id, r.start] == r.ids for r in found)
    none = token_frames.write_tokens(docs.limit(0), table_path(spark, "tokens"), *paths)
    assert none.count() == 0 and token_frames.read_tokens(none).count() == 0 and token_frames.find_tokens(none, wanted).count() == 0


def test_readers_touch_only_the_frames_they_need_and_check_them():
    rng, sink = np.random.default_rng(2), io.BytesIO()
    docs = [(i, rng.integers(0, 50_000, rng.integers(1, 300)).astype(np.uint32)) for i in range(500)]
    writer = token_frames.FrameWriter(sink, 2, 1_000)
    for i, ids in docs:
        writer.add(i, ids)
    frames = writer.close()
    data = sink.getvalue()
    whole = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True): r.read(1 << 20), b""))
    assert whole.startswith(np.concatenate([x for _, x in docs]).astype("<u2").tobytes())
    reader = token_frames.FrameReader(io.BytesIO(data), len(data))
    (_, start, ids), = reader.find(250)
    assert (ids == docs[250][1]).all() and start == sum(len(x) for _, x in docs[:250])
    assert len([i for i in reader.touched if i < frames]) <= 2
    assert [i for i, _, _ in reader.between(0, reader.tokens)] == list(range(500))
    broken = bytearray(data)
    broken[int(reader.at[3]) + reader.entries[3][0] // 2] ^= 1
    other = token_frames.FrameReader(io.BytesIO(bytes(broken)), len(broken))
    assert len(other.ids(0, 1_000)) == 1_000
    with pytest.raises((ValueError, zstandard.ZstdError)):
        other.ids(3_000, 3_001)


# --- hard negatives


def naive_negatives(rows, every, scale=256):
    rows = [(i, y, [int(np.floor(float(x) * scale)) for x in v]) for i, y, v in rows]
    out = []
    for i, y, v in rows:
        if i % every:
            continue
        score = sorted(((-sum(map(int.__mul__, v, w)), j, z) for j, z, w in rows if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for p, j, _ in [x for x in score if x[2] == y][:5]:
            fits = [(n, k) for n, k, z in score if z != y and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "spread"), [(16_384, 1.0), (3, 1.0), (16_384, 300_000.0)])
def test_negatives_equal_brute_force(spark, monkeypatch, anchors, spread):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 50)  # more tasks
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), (np.round(rng.random(4) * 3 - 0.7) / 4 * spread).tolist()) for i in range(300)]
    rows += [(300 + i, i % 3, rows[7][2]) for i in range(40)] + [(340 + i, i % 2, [0.5, 0.25]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(table, every=10).collect())
    assert got and got == naive_negatives(rows, 10)


def test_tiles_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 3)
    ids = [5, 1, 4, 2, 9, 7, 8, 3]
    vectors = [[1.0] * (1 + i % 2) for i in ids]
    batches = pa.table({"vec_id": ids, "label": [0] * 8, "v": pa.array(vectors, pa.list_(pa.float64()))}).to_batches(max_chunksize=5)
    seen = [(dim, i) for dim, some, _, v in hard_negatives._tiles(iter(batches)) for i in some.tolist() if v.shape[1] == dim]
    assert sorted(i for _, i in seen) == sorted(ids) and all(dim == 1 + i % 2 for dim, i in seen)


def test_odd_negatives(spark):
    good = [(i, i % 2, [1.0, i / 40]) for i in range(1, 12)]
    odd = [(0, None, [1.0, 1.0]), (20, 0, None), (21, 0, [None, 1.0]), (22, 1, [float("nan"), 1.0]), (23, 1, [float("inf"), 1.0]), (None, 1, [1.0, 1.0]), (24, 0, []), (25, 1, [1e30, 1.0]), good[3], good[4]]
    table = spark.createDataFrame([(*r, "x", 1) for r in good + odd], "vec_id long, label int, embedding array<float>, v string, rank int")
    kept = [(i, y, np.float32(v).tolist()) for i, y, v in [*good, (24, 0, [])]]
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(table, every=2).collect())
    assert got == naive_negatives(kept, 2)
    for empty in (table.limit(0), table.where("vec_id = 3")):
        out = hard_negatives.hard_negatives(empty, every=2)
        assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
