"""Snapshots as a stream: each arriving batch of rows is appended with its iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_snapshots(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a streaming DataFrame of particles as Parquet by iteration, each batch once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("iteration", F.lit(number)).write.mode("overwrite").parquet(f"{path}/iteration={number}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
