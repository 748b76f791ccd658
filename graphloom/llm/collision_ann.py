"""Operator 5: approximate nearest neighbours by collision counting over query-centred windows.

After QALSH (Huang et al., "Query-aware locality-sensitive hashing", 2015).  Each of ``PROJECTIONS``
hash functions is one random projection; a block of vectors keeps each projection as a sorted array.
A query takes a window around its own projection in every array.  Rehashing is virtual: the window
for radius R is R wide on either side, so going from R to c R only counts what the wider window
adds.  A vector within R of the query is in a window with a chance of 0.68 at least; vectors in
``THRESHOLD`` of the windows or more become candidates and are verified by their exact distance.
The search ends at the radius that holds the query's k-th candidate.

Vectors are dealt by a hash of their id into blocks of about ``BLOCK`` rows and queries into blocks
of ``QUERY_BLOCK``; a task gets one of each, so its memory is bounded whatever the table's size.  Each
row is indexed and every query meets every block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 120
THRESHOLD = 72
GROWTH = 1.15
BLOCK = 20_000
QUERY_BLOCK = 2_000
SEED = 7


def _first_radius(vectors: np.ndarray) -> float:
    """A radius below most nearest distances: half the least distance among a few spread rows."""
    some = vectors[:: max(1, len(vectors) // 64)][:64]
    d = np.sqrt(((some[:, None, :] - some[None]) ** 2).sum(2))
    d = d[d > 0]
    return float(d.min()) / 2 if len(d) else 1.0


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.lines = rng.standard_normal((PROJECTIONS, vectors.shape[1]))
        keys = self.lines @ vectors.T
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=1)
        self.radius = _first_radius(vectors)
        self.reach = np.abs(keys).max() if keys.size else 0.0

    def nearest(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest vectors found, ties to the smaller id."""
        n = len(self.ids)
        centre = self.lines @ query
        count = np.zeros(n, np.int32)
        left = right = np.array([np.searchsorted(row, c) for row, c in zip(self.keys, centre, strict=True)])
        checked = self.ids == own
        found, far = np.zeros(0, np.int64), np.zeros(0)
        radius, limit = self.radius, self.reach + np.abs(centre).max()
        want = min(k, int(n - checked.sum()))
        while want:
            radius = radius * GROWTH
            a = np.array([np.searchsorted(row, c - radius) for row, c in zip(self.keys, centre, strict=True)])
            b = np.array([np.searchsorted(row, c + radius, "right") for row, c in zip(self.keys, centre, strict=True)])
            a, b = np.minimum(a, left), np.maximum(b, right)
            rings = [self.order[j, x:y] for j in range(PROJECTIONS) for x, y in ((a[j], left[j]), (right[j], b[j])) if x < y]
            left, right = a, b
            if rings:
                count += np.bincount(np.concatenate(rings), minlength=n).astype(np.int32)
                new = np.flatnonzero((count >= THRESHOLD) & ~checked)
                if len(new):
                    checked[new] = True
                    d = np.sqrt(((self.vectors[new] - query) ** 2).sum(1))
                    found, far = np.concatenate([found, new]), np.concatenate([far, d])
                    best = np.lexsort((self.ids[found], far))
                    # all ties of the last place stay
                    keep = best[: np.searchsorted(far[best], far[best[min(k, len(best)) - 1]], "right")]
                    found, far = found[keep], far[keep]
            if len(found) >= want and np.partition(far, want - 1)[want - 1] <= radius or radius > limit:
                break
        best = np.lexsort((self.ids[found], far))[:k]
        return self.ids[found[best]], far[best]


def nearest_vectors(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k``
    nearest other rows found by Euclidean distance, nearest first and ties to the smaller id.

    Rows whose id or vector is null, or whose vector is empty, all zero or holds a null, NaN or
    infinite component, take no part.  Vectors of different length are never compared.  Equal rows
    count once; rows that share an id but not a vector are candidates each, and as queries the
    nearest to any of them counts.  A query with fewer than ``k`` candidates gets all of them.  Other
    columns are ignored; an empty table gives an empty one.
    """
    finite = f"forall({vector_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector_col}, x -> x <> 0)"
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).distinct().withColumn("dim", F.size("v"))
    total = rows.count()
    blocks, parts = max(1, -(-total // BLOCK)), max(1, -(-total // every // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(parts)).cast("int")
    data = rows.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if data.num_rows and queries.num_rows:
            dim = data["dim"][0].as_py()
            grid = lambda t: t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            index = Index(data["vec_id"].to_numpy(), grid(data))
            for own, q in zip(queries["vec_id"].to_pylist(), grid(queries), strict=True):
                ids, far = index.nearest(own, q, k)
                out[0] += [own] * len(ids)
                out[1] += ids.tolist()
                out[2] += far.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["dim", "block", "part"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
