"""Labelled rows for the classifiers, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import materialise


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether the remainder of crc32(id as text) by 5 is 0; such rows are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label, calibrates): at most ``rows`` learnable documents of each label, the same at each run.

    ``calibrates`` marks a quarter of them: those that set the calibration of a model learned from
    the others.  Labels that aren't 0 or 1 are left out; of several labels of a document the largest
    counts, of several texts the first in order.  The ids of the sample, at most 2 * ``rows``, are the
    broadcast side of the join with the texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return materialise(found.withColumn("calibrates", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4), "sample")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights (constant first) of a ridge logistic regression on scaled columns, by Newton steps."""
    scale = x.std(axis=0) + 1e-12
    a = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    w[1:] /= scale
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
