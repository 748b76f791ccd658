"""Operator 2: toxic passages by maximum-scoring segments over token log-odds.

* Token scores are log-odds of toxic against clean labelled text with an informative Dirichlet prior
  (Monroe, Colaresi and Quinn, "Fightin' Words", 2008), less a constant drift.  What is counted is
  in how many different left contexts a token occurs in a class, so a passage that was copied a
  thousand times counts once.  Scores whose z value is small are 0.
* All maximal segments of a document are found in one pass (Ruzzo and Tompa 1999); runs of tokens
  without a positive score are taken as one step, which leaves the segments as they are.
* Scores of segments become chances by extreme-value statistics (Karlin and Altschul 1990, 1993):
  lambda solves E[exp(lambda s)] = 1 over clean text, K is the maximum-likelihood location of the
  best segments of clean documents, and the r best segments of a document are judged together by the
  sum statistic.  A logistic regression on labelled rows turns the smallest of these chances and the
  number of significant segments into the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import labelled
from graphloom.llm import textnum as tn
from graphloom.llm.store import materialise

FIT_ROWS = 3_000  #: labelled rows of each class that are learned from, at most
VOCABULARY = 50_000  #: tokens of the model, those of the largest |z|
PRIOR = 0.05  #: weight of the prior, as a share of all counts
LEAST_Z = 2.0
DRIFT = 0.3
SIGNIFICANT = 0.05  #: expected number of such segments in clean text of the document's length
SUMS = 8  #: most segments that are judged together
THRESHOLD = 0.5

SEPARATOR = np.ones(256, bool)  # a token: a run of ASCII letters and digits and of bytes above them
for _span in ((48, 58), (65, 91), (97, 123), (128, 256)):
    SEPARATOR[_span[0] : _span[1]] = False


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, bounds by row)."""
    spaced = np.where(SEPARATOR[buf], np.uint8(32), buf)
    start, end, bounds = tn.words(spaced, offs)
    return tn.word_hashes(spaced, start, end), bounds


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, total) of every maximal scoring segment, in order (Ruzzo-Tompa).

    Linear in the number of positive scores: what lies between two of them only enters as a sum.
    """
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    found: list[list] = []  # [start, end, sum before it, sum at its end, index of a smaller one before]
    for i in at.tolist():
        start, low, high = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([start, i + 1, low, high, j])
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, h - x) for a, b, x, h, _ in found]


def _counts(sample: DataFrame) -> DataFrame:
    """(h, toxic, clean, toxic_early, clean_early): different left contexts of each token in each
    class, in all rows and in those that don't calibrate."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy(zero_copy_only=False)
            for first, buf, offs in tn.slices(batch.column(0)):
                h, bounds = tokens(buf, offs)
                before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
                before[bounds[:-1][np.diff(bounds) > 0]] = 0
                row = np.repeat(kind[first : first + len(offs) - 1], np.diff(bounds))
                for value in range(4):
                    pair = np.unique(np.stack([h[row == value], before[row == value]]), axis=1)
                    n = pair.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[0].view(np.int64)), pa.array(pair[1].view(np.int64)), pa.array(np.full(n, value // 2, np.int32)), pa.array(np.full(n, 1 - value % 2, np.int32))], ["h", "before", "label", "early"]
                    )

    seen = sample.select("text", "label", "calibrates").mapInArrow(contexts, "h long, before long, label int, early int")
    seen = seen.groupBy("h", "before", "label").agg(F.max("early").alias("early"))
    sums = {"toxic": "label", "clean": "1 - label", "toxic_early": "label * early", "clean_early": "(1 - label) * early"}
    return materialise(seen.groupBy("h").agg(*[F.sum(F.expr(x)).alias(name) for name, x in sums.items()]), "tokens")


def _token_scores(counts: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Hashes (sorted), scores, clean shares; and the clean share of all other tokens.  ``kind`` ends
    the names of the columns of counts that are learned from."""
    counts = counts.select("h", F.col(f"toxic{kind}").alias("toxic"), F.col(f"clean{kind}").alias("clean")).where("toxic + clean > 0")
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = float(total[0] or 0), float(total[1] or 0)
    a0 = max(1.0, PRIOR * (n1 + n0))
    alpha = (F.col("toxic") + F.col("clean")) * (a0 / max(1.0, n1 + n0))
    y1, y0 = F.col("toxic") + alpha, F.col("clean") + alpha
    odds = F.log(y1 / (F.lit(n1 + a0) - y1)) - F.log(y0 / (F.lit(n0 + a0) - y0))
    scored = counts.select("h", "clean", odds.alias("d"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
    top = scored.where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "h").limit(VOCABULARY).toPandas()  # at most VOCABULARY rows
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    share = (top["clean"].to_numpy(float) + 1e-3) / max(1.0, n0)
    return h[order], top["d"].to_numpy(float)[order] - DRIFT, share[order], max(1e-9, 1 - float(share.sum()))


def _lambda(score: np.ndarray, share: np.ndarray, rest: float) -> float:
    """The positive root of E[exp(x s)] = 1, or 1 if there is none."""
    value = lambda x: float((share * np.exp(np.minimum(x * score, 700))).sum() + rest * math.exp(-x * DRIFT)) - 1
    low, high = 1e-3, 1e-3
    while value(high) < 0 and high < 100:
        low, high = high, high * 1.5
    if value(low) >= 0 or value(high) < 0:
        return 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def _with_tokens(counts: DataFrame, kind: str) -> dict:
    hashes, scores, share, rest = _token_scores(counts, kind)
    return {"hashes": hashes, "scores": scores, "lambda": _lambda(scores, share, rest), "k": 1.0}


def _scores_of(h: np.ndarray, model: dict) -> np.ndarray:
    known, score = model["hashes"], model["scores"]
    if not len(known):
        return np.full(len(h), -DRIFT)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[place] == h, score[place], -DRIFT)


def _evidence(segments: list[tuple[int, int, float]], n: int, model: dict) -> tuple[float, int]:
    """(-log of the least chance over the r best segments, number of significant segments)."""
    lam, log_kn = model["lambda"], math.log(model["k"] * max(1, n))
    best, normal = 0.0, sorted((lam * s - log_kn for _, _, s in segments), reverse=True)
    total = 0.0
    for r, x in enumerate(normal[:SUMS], 1):
        total += x
        if total > 0:
            log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) if total > r else 0.0
            best = max(best, -log_p)
    return min(best, 60.0), sum(x > -math.log(SIGNIFICANT) for x in normal)


def _features(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """With each batch, for each row: tokens, -log chance, significant segments, sum of the best."""
    for batch in batches:
        out: list[tuple] = []
        for _, buf, offs in tn.slices(batch.column(0)):
            h, bounds = tokens(buf, offs)
            score = _scores_of(h, model)
            positive = np.concatenate([[0], np.cumsum(score > 0)])
            some = positive[bounds[1:]] - positive[bounds[:-1]]
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                segments = maximal_segments(score[a:b]) if some[i] else []
                out.append((b - a, *_evidence(segments, b - a, model), max((s for _, _, s in segments), default=0.0)))
        yield batch, out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> dict:
    """The model.  Learns from at most ``rows`` labelled rows of each class; what reaches the driver
    is bounded by ``rows`` and VOCABULARY."""
    sample = labelled.sample(docs, labels, label, rows)
    counts, late = _counts(sample), sample.where("calibrates")
    model = _with_tokens(counts, "_early")
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _features(batches, known.value):
            n, chance, many, best = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.float64()) for x in (n, chance, many, best))], ["label", "n", "chance", "many", "best"])

    def judged(rows: DataFrame) -> DataFrame:
        return rows.select("text", "label").mapInArrow(run, "label int, n double, chance double, many double, best double")

    def set_k(rows: DataFrame) -> None:
        hit = F.exp(-F.least(F.lit(700.0), F.lit(model["lambda"]) * F.col("best")))
        mass = judged(rows).where("label = 0").agg(F.count("*"), F.sum(F.col("n") * hit)).first()
        model["k"] = mass[0] / mass[1] if mass[0] and mass[1] else 1.0

    set_k(late)
    known = docs.sparkSession.sparkContext.broadcast(model)
    table = judged(late).toPandas()  # at most 2 * rows
    y = table["label"].to_numpy(float)
    if len(set(y.tolist())) == 2:
        weights = labelled.logistic(np.column_stack([table["chance"], np.log1p(table["many"])]), y)
    else:
        p = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        weights = np.array([np.log(p / (1 - p)), 0.0, 0.0])
    k = model["k"]
    return _with_tokens(counts, "") | {"k": k, "weights": weights}  # tokens of all rows, calibration of rows not learned from


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, chance (-log), n_segments.

    The score comes from the whole text alone and is the chance of label 1.  Null and empty texts have
    no segment and get the score of a text without one.  Without labelled rows of both classes every
    text gets the share of label 1 (0.5 without any).  Null and repeated doc_ids, other columns and
    texts of any length make no difference; an empty table gives an empty one.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _features(batches, known.value):
            _, chance, many, _ = (np.array(c, float) for c in zip(*found, strict=True)) if found else [np.zeros(0)] * 4
            p = labelled.probability(np.column_stack([chance, np.log1p(many)]), known.value["weights"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(chance), pa.array(many.astype(np.int64))],
                ["doc_id", "held_out", "score", "predicted", "chance", "n_segments"],
            )

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("held_out", F.coalesce(labelled.held_out(), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, chance double, n_segments long")


def passages(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, start, end, bits): every significant toxic passage, as a range of tokens."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            out = []
            for first, buf, offs in tn.slices(batch.column(0)):
                h, bounds = tokens(buf, offs)
                s = _scores_of(h, m)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for x, y, total in maximal_segments(s[a:b]):
                        bits = m["lambda"] * total - math.log(m["k"] * max(1, b - a))
                        if bits > -math.log(SIGNIFICANT):
                            out.append((first + i, x, y, bits / math.log(2)))
            if out:
                row, x, y, bits = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(bits)], ["doc_id", "start", "end", "bits"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, bits double")
