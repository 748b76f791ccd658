"""Where operators keep what they read again.

Results that several steps read are written as tables (:func:`materialise`), which also ends the
plan: a plan that reads cached plans that read cached plans doubles with each of them when Spark
describes it.  Tables that no later step needs are dropped (:func:`drop`).

A written table survives a lost executor, unlike an executor-local checkpoint.  The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark runs in one
process (tests, notebooks) a temporary folder is used instead.  A cluster without it is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/graphloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a checkpoint that is columnar,
    compressed and readable by every executor."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Delete a table that :func:`materialise` returned; nothing that reads it may run later."""
    for name in {x.rpartition("/")[0] for x in df.inputFiles()} if df is not None else ():
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1_000) -> SparkSession:
    """Let Spark send at most ``rows`` rows to a Python worker at a time: texts are long, and two
    workers share an executor's memory with its heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    return spark
