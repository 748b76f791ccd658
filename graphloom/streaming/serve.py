"""Requests that arrive as a stream: each micro-batch is answered by the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans import service
from graphloom.schema import Model


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(body) of request lines in files that appear under ``path``."""
    return spark.readStream.text(path).where("value <> ''").select(F.col("value").alias("body"))


def serve(requests: DataFrame, model: Model, out: str, checkpoint: str, version: str | None = None) -> StreamingQuery:
    """Answer every micro-batch into ``out/replies``.  Its requests are logged with a number each in
    ``out/requests`` first, so equal requests are answered one by one and every part of the answer sees
    the same numbers.  A batch that is run again after a failure overwrites its own folders, so
    replies come once."""

    def answer(batch: DataFrame, number: int) -> None:
        log = f"{out}/requests/batch={number}"
        batch.select(F.monotonically_increasing_id().alias("request_id"), "body").write.mode("overwrite").parquet(log)
        asked = batch.sparkSession.read.schema("request_id long, body string").parquet(log)
        service.respond(asked, model, version).write.mode("overwrite").json(f"{out}/replies/batch={number}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
