"""Operator 3: quality by compression: two zstandard dictionaries, one built from good and one from
bad labelled text.

A text is compressed in blocks with either dictionary and with none.  Its evidence is the difference
of the two sizes over the size without a dictionary, the normalised compressed-size difference; a
logistic regression on labelled rows, whose dictionaries were built without them, turns it into a
probability.  The blocks keep a long text from teaching the compressor its own vocabulary, which
would drown the dictionaries; every block of the whole text counts.

Dictionaries are trained from blocks that are drawn by a hash from the whole texts of the labelled
sample; what reaches the driver is bounded by SAMPLES blocks and FIT_ROWS numbers of each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import labelled

FIT_ROWS = 3_000  #: labelled rows of each class that are learned from, at most
SAMPLES = 4_000  #: blocks of each class that a dictionary is trained from, at most
DICTIONARY = 65_536  #: bytes of a dictionary
BLOCK = 2_048  #: bytes that are compressed together
LEVEL = 3
THRESHOLD = 0.3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; as many samples as fill one where the trainer finds too little in them."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.each = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data) if data else None
            if known:
                known.precompute_compress(level=LEVEL)
            self.each.append(zstandard.ZstdCompressor(dict_data=known, **plain) if known else zstandard.ZstdCompressor(**plain))
        self.each.append(zstandard.ZstdCompressor(**plain))

    def evidence(self, text: str | None) -> tuple[float, int]:
        """(normalised difference, bytes)."""
        data = (text or "").encode()
        good, bad, plain = (sum(len(c.compress(b)) for b in _blocks(data)) for c in self.each)
        return ((bad - good) / plain, len(data)) if data else (0.0, 0)


def _training_blocks(known: DataFrame) -> DataFrame:
    """(label, block): blocks of the whole texts of the rows that don't calibrate, at most SAMPLES of a
    class.  Lines that several rows share are left out first, as they tell texts of one origin, not of
    one quality; so is a line's repetition in a text."""
    line = known.select("doc_id", "label", "calibrates", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    once = line.groupBy("line").agg(F.min(F.struct("doc_id", "pos", "label", "calibrates")).alias("x"), F.max("doc_id").alias("last"))
    once = once.where("x.doc_id = last and not x.calibrates").select("x.doc_id", "x.pos", "x.label", "line")
    own = once.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    own = own.select("doc_id", "label", F.encode(F.array_join("lines.line", "\n"), "utf-8").alias("data")).where("octet_length(data) > 0")
    cut = F.expr(f"transform(sequence(0, cast((octet_length(data) - 1) div {BLOCK} as int)), i -> substring(data, i * {BLOCK} + 1, {BLOCK}))")
    blocks = own.select("doc_id", "label", F.posexplode(cut).alias("i", "block")).where("octet_length(block) >= 8")
    drawn = None
    for value in (0, 1):
        part = blocks.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i").limit(SAMPLES)
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn.select("label", "block")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> dict:
    """The model: two dictionaries, weights and the share of label 1.  Learns from the whole texts of at
    most ``rows`` labelled rows of each class; a quarter of them set the calibration only."""
    known = labelled.sample(docs, labels, label, rows)
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in _training_blocks(known).collect():  # at most 2 * SAMPLES blocks
        samples[r["label"]].append(bytes(r["block"]))
    share = known.agg(F.avg("label"), F.count_if("calibrates")).first()
    model = {"good": _dictionary(samples[1]), "bad": _dictionary(samples[0]), "prior": 0.5 if share[0] is None else float(share[0])}
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(sent.value["good"], sent.value["bad"])
        for batch in batches:
            x = [compressors.evidence(t.as_py())[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["label", "difference"])

    rest = known.where("calibrates") if share[1] else known
    table = rest.select("label", "text").mapInArrow(judge, "label int, difference double").toPandas()  # at most 2 * rows numbers
    y = table["label"].to_numpy(float)
    if len(set(y.tolist())) == 2:
        model["weights"] = labelled.logistic(table[["difference"]].to_numpy(), y)
    else:
        p = min(max(model["prior"], 0.01), 0.99)
        model["weights"] = np.array([np.log(p / (1 - p)), 0.0])
    return model


def _probabilities(texts, compressors: Compressors, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(chance of label 1, difference) of each text."""
    x = np.array([compressors.evidence(t) for t in texts], float).reshape(-1, 2)
    return np.where(x[:, 1] > 0, labelled.probability(x[:, :1], model["weights"]), model["prior"]), x[:, 0]


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, difference.

    The score comes from the text alone and is the chance of label 1.  A null or empty text gets the
    share of label 1 among the rows learned from; without labelled rows of both classes, all texts get
    that share (0.5 without any).  Null and repeated doc_ids, other columns and texts of any length
    make no difference; an empty table gives an empty one.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(known.value["good"], known.value["bad"])
        for batch in batches:
            p, difference = _probabilities((t.as_py() for t in batch.column(1)), compressors, known.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(difference)], ["doc_id", "held_out", "score", "predicted", "difference"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(labelled.held_out(), F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, difference double")


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, with all their columns."""
    from pyspark.sql.types import BooleanType

    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(BooleanType())
    def good(text: pd.Series) -> pd.Series:
        compressors = Compressors(known.value["good"], known.value["bad"])
        return pd.Series(_probabilities(text, compressors, known.value)[0] >= threshold)

    return docs.where(good(F.col("text").cast("string")))
