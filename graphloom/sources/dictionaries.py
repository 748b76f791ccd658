"""A dictionary of labels that grows from run to run and never changes an id.

A folder holds one Parquet table for each committed batch.  A batch gives ids to the labels that no batch
before it has, from the highest id on, in order of the label.  A batch counts once its table is
complete; committing it again changes nothing, and what an unfinished commit left is written over.
There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import labels as lb

SCHEMA = "label string, id long"


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The folders of complete batches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    done = [x.getPath() for x in system.listStatus(place) if x.isDirectory()]
    return sorted(str(x) for x in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """(label, id) of all committed batches; empty where there is none."""
    found = _batches(spark, path)
    return spark.read.schema(SCHEMA).parquet(*found) if found else spark.createDataFrame([], SCHEMA)


def commit(labels: DataFrame, path: str, batch: str) -> bool:
    """Add the labels (label) that the dictionary lacks; False, and nothing changes, if ``batch`` was
    committed before.  Null labels are none; repeated ones count once."""
    spark, target = labels.sparkSession, f"{path}/batch-{batch}"
    done = _batches(spark, path)
    if any(x.rpartition("/")[2] == f"batch-{batch}" for x in done):
        return False
    known = load(spark, path)
    start = known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    new = lb.dictionary(labels.select("label").join(known, "label", "left_anti"))
    new.select("label", (F.col("id") + start).alias("id")).write.mode("overwrite").parquet(target)
    return True


def with_ids(nodes: DataFrame, dictionary: DataFrame, label: str = "label") -> DataFrame:
    """``nodes`` with the column label_id: the id of a label, -1 for one that the dictionary lacks, null for none."""
    ids = dictionary.select(F.col("label").alias(label), F.col("id").alias("label_id"))
    return nodes.join(ids, label, "left").withColumn("label_id", F.when(F.col(label).isNotNull(), F.coalesce("label_id", F.lit(-1).cast("long"))))
