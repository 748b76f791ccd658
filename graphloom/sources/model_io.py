"""Models and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import FACTOR_FEATURES, LABEL_FREQ, PAIR_FEATURES, Model


def save_model(model: Model, path: str) -> None:
    """Pair features, factor features and label frequencies, each a Parquet table under ``path``."""
    for name, table in (("pair_features", model.pairs), ("factor_features", model.factors), ("label_freq", model.label_freq)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> Model:
    """All of a saved model, factors included."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return Model(read("pair_features", PAIR_FEATURES), read("factor_features", FACTOR_FEATURES), read("label_freq", LABEL_FREQ))


def save_report(report: DataFrame, path: str, compression: str = "none") -> None:
    """Lines of a report (value) as text, in their order."""
    report.coalesce(1).write.mode("overwrite").option("compression", compression).text(path)


def append_log(requests: DataFrame, path: str) -> None:
    """Requests and replies as JSON lines with the UTC time they were written, whatever the session's zone;
    files are only added."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    requests.withColumn("time", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)
