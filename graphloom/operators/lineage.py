"""Cutting the lineage of loops that feed a result back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only Spark in one process may do
    without it and gets a temporary one."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Unlike a checkpoint the table is columnar, has its size for the optimizer, and brings no constraints
    of the plan that made it: those of a loop's rounds add up until planning takes minutes.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/graphloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str | None) -> Iterator[None]:
    """With ``name`` of the session set to ``value``, if there is one."""
    before = spark.conf.get(name)
    if value is not None:
        spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, by: str, parts: int) -> DataFrame:
    """``df`` written once as a table of ``parts`` buckets of ``by`` in the shared folder.

    Rows that were dealt by ``by`` to as many tasks are written where they lie, and what reads the table finds them dealt so:
    neither counting nor scoring a corpus has to shuffle it again.
    """
    name = f"graphloom_kept_{uuid.uuid4().hex}"
    place = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}"
    # a task has rows of one bucket, or of a few, so they needn't be sorted by bucket to be written
    with _setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", "16"):
        df.write.format("parquet").bucketBy(parts, by).option("path", place).option("compression", "zstd").saveAsTable(name)
    table = df.sparkSession.table(name)
    return table.toDF(*table.columns)  # names without that of the table: a union compares how its parts are dealt by whole names


def laid(df: DataFrame, parts: int | None) -> DataFrame:
    """:func:`cut` for a table with rows of graphs; with ``parts`` its rows lie in as many buckets of query_id, as those
    of all tables of the corpus then do."""
    return cut(df) if parts is None else kept(df.repartition(parts, "query_id"), "query_id", parts)


@contextmanager
def by_graph(spark: SparkSession, parts: int | None) -> Iterator[None]:
    """With ``parts``, tables dealt by query_id meet on it and more columns where they lie; what is planned inside must be
    written there.

    By default Spark deals both again by all columns of such a join, and then whatever meets its result.
    """
    with _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", None if parts is None else "false"):
        yield


def apart(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df``, a table with rows for every graph, to be joined where it lies: by sort and merge, however small it is.

    Spark would send it through the driver to all executors where its file is small, but files of ids and
    labels are many times smaller than their rows, and a search has some hundred joins.  A part of a corpus that is dealt
    into ``parts`` is small enough to be looked up by hash, so nothing is sorted there.
    """
    return df.hint("merge" if parts is None else "shuffle_hash")


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` returned; nothing that reads it may run later."""
    for name in {x.rpartition("/")[0] for x in df.inputFiles()}:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
