"""Operator 4: token counts as delta-maintained rollups.

A rollup lives in one folder of the shared store:

* ``ledger/batch=<id>/bucket=<b>``: signed rows (doc_id, tokenizer, source, lang, n_tokens, sign), dealt
  by a hash of doc_id; what a document contributes now is the sum of its signed rows, so nothing is
  ever updated in place, and a batch reads only the buckets of the documents that it changes;
* ``totals/batch=<id>``: the batch's deltas, (source, lang, tokenizer, n_docs, n_tokens), added up;
* ``commits/batch=<id>``: a marker that is written last.

A batch holds inserts, deletes and revised counts.  Each change turns into signed rows against the
ledger of the committed batches before it: a delete withdraws what the document contributes, a revision
withdraws it and adds the new count, also under another source or language.  Totals are sums of
deltas over committed batches; they are additive, so batches can be merged in any grouping.

Committing is idempotent: a batch that is committed is skipped, and one that was cut short leaves no
marker, isn't read, and is written anew in the same place.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.store import drop, materialise

KEYS = ("doc_id", "tokenizer")
GROUP = ("source", "lang", "tokenizer")
BUCKETS = 64  #: of the ledger
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, sign long, batch string, bucket int"


def word_count(text: str = "text") -> Column:
    """words_v1: runs without ASCII white space; a null text has none."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def byte_count(text: str = "text") -> Column:
    """bytes_v1: one token for each UTF-8 byte, as byte-level models without a vocabulary have them."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def bpe_count(tokenizer: str, ranks: str | None = None) -> Callable[[str], Column]:
    """A counter of the tokens of a tokenizers file (see :func:`graphloom.llm.packing.load_tokenizer`)."""
    from pyspark.sql.types import LongType

    from graphloom.llm.packing import load_tokenizer

    held: dict = {}

    @F.pandas_udf(LongType())
    def count(text: pd.Series) -> pd.Series:
        encode = held.get(0) or held.setdefault(0, load_tokenizer(tokenizer, ranks))
        return pd.Series([len(encode(t)) if isinstance(t, str) and t else 0 for t in text], dtype="int64")

    return lambda column="text": count(F.col(column))


#: Tokenizer versions that SQL can count too.
COUNTERS: dict[str, Callable[[str], Column]] = {"words_v1": word_count, "bytes_v1": byte_count}


def counts(docs: DataFrame, counters: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """(doc_id, tokenizer, source, lang, n_tokens): a row for each document and tokenizer, from one scan."""
    each = [F.struct(F.lit(name).alias("tokenizer"), f("text").alias("n_tokens")) for name, f in (counters or COUNTERS).items()]
    return docs.select("doc_id", "source", "lang", F.explode(F.array(*each)).alias("t")).select("doc_id", "t.tokenizer", "source", "lang", "t.n_tokens")


class Rollup:
    """A maintained rollup under ``path``, a folder every executor can read and write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, part: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def committed(self) -> list[str]:
        """Ids of the committed batches, in order."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def _read(self, table: str, batches: list[str]) -> DataFrame | None:
        if not batches:
            return None
        if table == "ledger":
            read = self.spark.read.schema(LEDGER).option("basePath", f"{self.path}/{table}")
            return read.parquet(*[f"{self.path}/{table}/batch={b}" for b in batches]).drop("batch")
        return self.spark.read.parquet(*[f"{self.path}/{table}/batch={b}" for b in batches])

    def current(self, batches: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """What each document contributes now: (doc_id, tokenizer, source, lang, n_tokens, n_docs); of
        ``buckets`` of the ledger only, if they are named."""
        ledger = self._read("ledger", self.committed() if batches is None else batches)
        if ledger is None:
            return None
        if buckets is not None:
            ledger = ledger.where(F.col("bucket").isin(buckets))
        net = ledger.groupBy(*KEYS, "source", "lang", "n_tokens").agg(F.sum("sign").alias("n_docs"))
        return net.where("n_docs <> 0")

    def _write(self, signed: DataFrame, table: str, batch: str) -> None:
        dealt = signed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{table}/batch={batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes once; False if it was applied before.

        ``changes``: op ('insert', 'delete' or 'revise'), doc_id, tokenizer, source, lang, n_tokens and
        seq, which orders several changes of one document in the batch (the last one wins; of equal
        ones, the largest count).  A delete or revision of a document that isn't there withdraws
        nothing, and an insert of one that is there counts as a revision, so totals never count a
        document twice.  A null doc_id is left out, as nothing could withdraw it; a null count is 0.
        """
        if self._exists(f"commits/batch={batch}"):
            return False
        before = [b for b in self.committed() if b != batch]
        columns = [F.col(c) for c in (*KEYS, "source", "lang")]
        rows = changes.where("doc_id is not null and tokenizer is not null")
        rows = rows.select("op", *columns, F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"))
        last = rows.groupBy(*KEYS).agg(F.max(F.struct("seq", "n_tokens", "op", "source", "lang")).alias("x")).select(*KEYS, "x.*").drop("seq")
        signed = last.where("op <> 'delete'").select(*columns, "n_tokens", F.lit(1).cast("long").alias("sign"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        if before:
            touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most BUCKETS numbers
            now = self.current(before, touched)
            gone = now.join(last.select(*KEYS), list(KEYS), "left_semi")
            signed = signed.unionByName(gone.select(*columns, "n_tokens", (-F.col("n_docs")).alias("sign")))
        self._write(signed, "ledger", batch)
        written = self._read("ledger", [batch])
        delta = written.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): sums of the committed deltas, without empty groups."""
        deltas = self._read("totals", self.committed())
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self, into: str) -> None:
        """Merge the committed batches into one new rollup at ``into``; its totals are the same."""
        other = Rollup(self.spark, into)
        now = self.current()
        if now is None:
            return
        other._write(now.withColumnRenamed("n_docs", "sign"), "ledger", "0")
        self.totals().write.mode("overwrite").parquet(f"{other.path}/totals/batch=0")
        self.spark.range(1).write.mode("overwrite").parquet(f"{other.path}/commits/batch=0")


def rollup_documents(docs: DataFrame, path: str, counters: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """Token totals of ``docs`` by source, language and tokenizer version, maintained in three batches
    at ``path``: all documents are inserted with one token as a stand-in, as if not counted yet; every
    count is revised to that of its tokenizer, and the revision is replayed, which does nothing; then
    counts of documents without a token are deleted.

    Rows that share a doc_id are one document, whose largest row in (n_tokens, source, lang) counts; a null
    doc_id is left out; a null source or language is a group of its own; a null text has no tokens.
    """
    rollup = Rollup(docs.sparkSession, path)
    counted = materialise(counts(docs.where("doc_id is not null"), counters).withColumn("doc_id", F.col("doc_id").cast("long")), "counts")
    change = lambda rows, op, n: rows.select(F.lit(op).alias("op"), "doc_id", "tokenizer", "source", "lang", n.cast("long").alias("n_tokens"), F.lit(0).alias("seq"))
    rollup.commit("0001-insert", change(counted, "insert", F.lit(1)))
    revised = change(counted, "revise", F.col("n_tokens"))
    rollup.commit("0002-revise", revised)
    rollup.commit("0002-revise", revised)  # a replay changes nothing
    empty = rollup.current().where("n_tokens = 0")
    rollup.commit("0003-delete", change(empty, "delete", F.col("n_tokens")))
    drop(counted)
    return rollup.totals()
