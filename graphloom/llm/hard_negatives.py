"""Operator 13: hard-negative mining by blocked dense matrix products.

Anchors are broadcast a block at a time; tasks meet the block with tiles of candidates, whose scores are
one matrix product in float64.  Components are whole numbers, so products and sums are exact below
2**53; where the norms of a block and a tile don't keep scores (times a hundred) below that, the product
is taken in 64-bit whole numbers.

1. First pass: the best ``positives`` rows of an anchor's label.  Tiles are met label by label, a
   task merges what its tiles give, a window merges all tasks.
2. Second pass: for each anchor and positive the best ``negatives`` rows of other labels whose score
   lies in a window of the positive's.  Only scores in the widest window of an anchor leave the
   matrix; tasks and then a window merge them as before.

Memory: a block is about ANCHORS rows (the driver and each worker hold one, with its positives), a tile
TILE_ANCHORS x TILE_ROWS scores.  A task sends at most ANCHORS x positives x negatives rows, however many
rows share a label, a vector or a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.store import materialise, table_path

ANCHORS = 16_384  #: anchors of a broadcast block (8 MB at 64 components)
TILE_ANCHORS, TILE_ROWS = 512, 4_096
TASK_PAIRS = 20_000_000  #: scores of a task, about half a second
EXACT = 2.0**46  #: scores below it are exact in float64, times a hundred too
NORM = 2**28  #: rows of this norm or more take no part: a hundred times a score could leave 64 bits
NONE = np.iinfo(np.int64).min


def whole_rows(table: DataFrame, label: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, with whole-number components; one row an id."""
    v = F.expr(f"transform({vector_col}, x -> cast(x as double) * {scale}D)")
    rows = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where("label is not null")
    rows = rows.where(f"forall(v, x -> x is not null and not isnan(x) and abs(x) < {NORM}D)")
    rows = rows.withColumn("v", F.expr("transform(v, x -> cast(floor(x) as double))")).where(f"aggregate(v, 0D, (s, x) -> s + x * x) < {float(NORM) ** 2:.0f}D")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")


def _grid(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, labels, vectors) of up to TILE_ROWS rows, by id."""

    def tiles(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        table = table.combine_chunks().sort_by("vec_id")
        sizes = np.asarray(pa.compute.list_value_length(table["v"].combine_chunks()))
        for dim in np.unique(sizes).tolist():
            part = table.filter(pa.array(sizes == dim)).combine_chunks()
            yield dim, part["vec_id"].to_numpy(), part["label"].to_numpy(), _grid(part["v"].combine_chunks(), dim)

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            held.append(batch.slice(at, TILE_ROWS))
            size += held[-1].num_rows
            if size >= TILE_ROWS:
                whole = pa.Table.from_batches(held)
                yield from tiles(whole.slice(0, TILE_ROWS))
                held = whole.slice(TILE_ROWS).to_batches()
                size -= TILE_ROWS
    if size:
        yield from tiles(pa.Table.from_batches(held))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, exact."""
    norm = lambda x: np.sqrt((x * x).sum(1).max()) if len(x) else 0.0
    if norm(a) * norm(b) < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of each row, best first; ids ascend in a row, so ties go to the smaller.
    Missing ones have the score NONE.  Overwrites ``scores``."""
    out, who, rows = np.full((len(scores), k), NONE), np.zeros((len(scores), k), np.int64), np.arange(len(scores))
    for j in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        out[:, j], who[:, j] = scores[rows, at], ids[rows, at] if ids.ndim == 2 else ids[at]
        scores[rows, at] = NONE
    return out, who


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two results of :func:`_best`."""
    scores, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.argsort(ids, axis=1, kind="stable")
    return _best(np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1), a[0].shape[1])


def _block(anchors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """dimension -> (ids, labels, vectors) of a block of anchors."""
    return {dim: (ids, labels, v) for dim, ids, labels, v in _parts(anchors.toArrow())}


def _parts(table: pa.Table):
    sizes = np.asarray(pa.compute.list_value_length(table["v"].combine_chunks())) if table.num_rows else np.zeros(0, int)
    for dim in np.unique(sizes).tolist():
        part = table.filter(pa.array(sizes == dim)).combine_chunks()
        yield dim, part["vec_id"].to_numpy(), part["label"].to_numpy(), _grid(part["v"].combine_chunks(), dim)


def _positives(rows: DataFrame, block: dict, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): best rows of the label, of each task and then of all."""
    known = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {dim: (np.full((len(a[0]), k), NONE), np.zeros((len(a[0]), k), np.int64)) for dim, a in known.value.items()}
        for dim, ids, labels, v in _tiles(batches):
            if dim not in found:
                continue
            anchor_ids, anchor_labels, anchor_v = known.value[dim]
            for label in np.intersect1d(labels, anchor_labels).tolist():
                mine, theirs = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
                for at in range(0, len(mine), TILE_ANCHORS):
                    some = mine[at : at + TILE_ANCHORS]
                    scores = _scores(anchor_v[some], v[theirs])
                    scores[anchor_ids[some][:, None] == ids[theirs][None, :]] = NONE
                    better = _merge((found[dim][0][some], found[dim][1][some]), _best(scores, ids[theirs], k))
                    found[dim][0][some], found[dim][1][some] = better
        for dim, (scores, ids) in found.items():
            r, j = np.nonzero(scores != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (known.value[dim][0][r], ids[r, j], scores[r, j])], ["anchor_id", "positive_id", "positive_score"])

    each = rows.mapInArrow(search, "anchor_id long, positive_id long, positive_score long")
    turn = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return each.withColumn("turn", turn).where(F.col("turn") <= k)


def _in_windows(scores: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(j, rows, best): of each row the k best scores from low[row, j] to high[row, j].  Overwrites nothing."""
    useful = low <= high
    least, most = np.where(useful, low, -(NONE + 1)).min(1), np.where(useful, high, NONE).max(1)
    r, c = np.nonzero((scores >= least[:, None]) & (scores <= most[:, None]))
    s = scores[r, c]
    order = np.lexsort((c, -s, r))  # columns ascend with ids
    r, c, s = r[order], c[order], s[order]
    for j in range(low.shape[1]):
        ok = np.flatnonzero((s >= low[r, j]) & (s <= high[r, j]))
        if not len(ok):
            continue
        place = np.arange(len(ok)) - np.searchsorted(r[ok], r[ok])
        ok, place = ok[place < k], place[place < k]
        rows, which = np.unique(r[ok], return_inverse=True)
        best, who = np.full((len(rows), k), NONE), np.zeros((len(rows), k), np.int64)
        best[which, place], who[which, place] = s[ok], ids[c[ok]]
        yield j, rows, (best, who)


def _negatives(rows: DataFrame, block: dict, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, rank, negative_id, negative_score)."""
    known = rows.sparkSession.sparkContext.broadcast(block)
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {dim: (np.full((*a[3].shape, k), NONE), np.zeros((*a[3].shape, k), np.int64)) for dim, a in known.value.items()}
        for dim, ids, labels, v in _tiles(batches):
            if dim not in found:
                continue
            _, anchor_labels, anchor_v, positive, _ = known.value[dim]
            there = positive != NONE
            least = np.where(there, -(-low * np.where(there, positive, 0) // 100), 1)
            most = np.where(there, high * np.where(there, positive, 0) // 100, 0)
            for at in range(0, len(anchor_v), TILE_ANCHORS):
                some = slice(at, at + TILE_ANCHORS)
                scores = _scores(anchor_v[some], v)
                scores[anchor_labels[some][:, None] == labels[None, :]] = NONE
                for j, r, best in _in_windows(scores, ids, least[some], most[some], k):
                    r = r + at
                    better = _merge((found[dim][0][r, j], found[dim][1][r, j]), best)
                    found[dim][0][r, j], found[dim][1][r, j] = better
        for dim, (scores, ids) in found.items():
            r, j, i = np.nonzero(scores != NONE)
            anchor, _, _, positive, who = known.value[dim]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[r], who[r, j], positive[r, j], ids[r, j, i], scores[r, j, i])], [x.split()[0] for x in schema.split(", ")])

    each = rows.mapInArrow(search, schema)
    turn = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return each.withColumn("rank", turn).where(F.col("rank") <= k)


def _with_positives(block: dict, found: pa.Table, k: int) -> dict:
    """The block with the scores and ids of each anchor's positives, padded with NONE."""
    anchor, who, score, turn = (found[c].to_numpy() for c in ("anchor_id", "positive_id", "positive_score", "turn"))
    out = {}
    for dim, (ids, labels, v) in block.items():
        scores, partners = np.full((len(ids), k), NONE), np.zeros((len(ids), k), np.int64)
        order = np.argsort(ids)
        place = np.minimum(np.searchsorted(ids[order], anchor), len(ids) - 1)
        mine = ids[order][place] == anchor
        scores[order[place[mine]], turn[mine] - 1], partners[order[place[mine]], turn[mine] - 1] = score[mine], who[mine]
        out[dim] = (ids, labels, v, scores, partners)
    return out


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product with the anchor, higher ones
    first, ties by smaller id.  Anchors are the rows whose id is divisible by ``every``.  An anchor's
    positives are its first ``positives`` other rows of the same label; for each of them the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score are returned, ranked from 1 (all, if fewer).  ``label`` is the label's column or an
    expression over ``table``.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do rows of a
    norm of 2**28 or more after scaling, whose scores would leave 64 bits.  Of rows that share an id the one
    with the least label and then vector takes part.  Vectors of different length are never compared.  A
    negative score of a positive has no window.  Other columns are ignored; an empty table, or one without
    anchors, gives an empty one.
    """
    spark = table.sparkSession
    label = F.col("label") if label is None else label
    total, asked = table.agg(F.count("*"), F.count_if(F.col(id_col) % every == 0)).first()
    parts = max(1, min(-(-total * max(1, asked) // TASK_PAIRS), -(-total // TILE_ROWS)))
    rows = materialise(whole_rows(table.withColumnRenamed(id_col, "vec_id").repartition(parts, "vec_id"), label, scale, "vec_id", vector_col), "vectors")
    blocks, written = max(1, -(-asked // ANCHORS)), []
    for b in range(blocks):
        anchors = rows.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b))
        block = _block(anchors)  # about ANCHORS rows
        if not block:
            continue
        # at most `positives` rows an anchor
        block = _with_positives(block, _positives(rows, block, positives).toArrow(), positives)
        written.append(table_path(spark, "negatives"))
        _negatives(rows, block, negatives, low, high).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.parquet(written[-1])
    return spark.read.schema(RESULT).parquet(*written) if written else spark.createDataFrame([], RESULT)
