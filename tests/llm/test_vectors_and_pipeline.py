"""Nearest neighbours against brute force, and the pipeline stage by stage."""

import re

import numpy as np

import corpus_pipeline
from graphloom.llm import collision_ann, quality, queries, secret_scan
from tests.llm.test_text_operators import naive_components, shingles


def brute(ids, vectors, own, k):
    d = np.sqrt(((vectors - vectors[ids == own][0]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_nearest_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(collision_ann, "BLOCK", 150)
    monkeypatch.setattr(collision_ann, "QUERY_BLOCK", 3)
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ok = [v is not None and np.isfinite(np.array(v, float)).all() and np.any(v) for v in table["embedding"]]
    table = table[ok]
    ids, vectors = table["vec_id"].to_numpy(), np.stack([np.array(v, float) for v in table["embedding"]])
    got = queries.op5_approximate_nearest_neighbours(spark, sf).toPandas()
    hits = total = 0
    for own in ids[ids % 100 == 0].tolist():
        mine = got[got["query_id"] == own].sort_values("rank")
        want = brute(ids, vectors, own, 10)
        assert mine["rank"].tolist() == list(range(1, len(want) + 1))
        assert mine["score"].is_monotonic_increasing and own not in set(mine["vec_id"])
        for v, s in zip(mine["vec_id"], mine["score"], strict=True):
            assert abs(s - np.sqrt(((vectors[ids == v][0] - vectors[ids == own][0]) ** 2).sum())) < 1e-12
        hits += len(set(mine["vec_id"]) & {i for i, _ in want})
        total += len(want)
    assert total and hits / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0, 5.0])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, block string, part string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in collision_ann.nearest_vectors(table, every=100).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 9, 1.0)]
    assert collision_ann.nearest_vectors(table.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    text = lambda d: {r.doc_id: r.text for r in d.collect()}

    one = stage["quality_classifier"](spark, docs, sf).cache()
    # its score is held against recomputed sizes in test_quality_scores_equal_recomputed_sizes
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert one.columns == docs.columns and set(text(one)) == {r.doc_id for r in scored if r.score >= 0.3}

    two = stage["ngram_jaccard_join"](spark, one, sf).cache()
    group = naive_components(list(text(one).items()), 5, 80)
    assert two.columns == docs.columns and set(text(two)) == {i for i, g in group.items() if i == g}

    three = stage["benchmark_decontamination"](spark, two, sf).cache()
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {i for i, t in text(two).items() for s in [shingles(t, 5)] if any(100 * len(q & s) >= 80 * len(q) for q in items if q)}
    assert dirty and set(text(three)) == set(text(two)) - dirty

    four = stage["secret_scans"](spark, three, sf).cache()
    before, after = text(three), text(four)
    assert set(before) == set(after) and four.columns == docs.columns
    assert all(after[i] == secret_scan.redact(t) and not re.search(r"AKIA[A-Z0-9]{12,}", after[i] or "") for i, t in before.items())

    five = stage["best_fit_packing"](spark, four, sf).toPandas()
    assert set(five["doc_id"]) == set(after) and five.groupby("sequence_id")["length"].sum().max() <= 1024


def test_unlike_texts_of_one_id_stay_and_leaks_without_an_id_go(spark, sf):
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len((r.text or "").split()) > 10)
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "en", "web", 9), (1, b, "en", "web", 9), (1, b, "de", "web", 9), (2, c, "en", "web", 9), (3, c, "en", "web", 9), (None, item, "en", "web", 6), (None, a, "en", "web", 9), (4, "so " + item, "en", "web", 9), (4, a, "fr", "web", 9), (5, None, "en", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    two = sorted(map(str, (tuple(r) for r in stage["ngram_jaccard_join"](spark, docs, sf).collect())))
    # 4 holds the text of 1 and is linked with it
    assert two == sorted(map(str, [rows[0], rows[2], rows[3], rows[5], rows[6], rows[9]]))
    three = sorted(map(str, (tuple(r) for r in stage["benchmark_decontamination"](spark, docs, sf).collect())))
    assert three == sorted(map(str, [r for r in rows if item not in (r[1] or "")]))


def test_pipeline_with_odd_rows_and_without_rows(spark, sf, docs_of):
    from tests.llm.conftest import ODD

    docs = docs_of(ODD)
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, sf)
            if name == "best_fit_packing":
                assert (out.count() > 0) == (d is docs)
            else:
                assert out.columns == docs.columns
                out.count()
