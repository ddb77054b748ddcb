"""Appending new addresses from a stream of candidate files, and dedupe of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.text import building_key
from plumbline.operators.compare import append_new


def append_stream(candidates: DataFrame, target: str, checkpoint: str, column: str = "address") -> StreamingQuery:
    """Appends to the Parquet table at target, batch by batch, what is new there. A batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("row_idx long, address string, key string").parquet(target).select("key")
        new = append_new(batch.select("row_idx", F.col(column).alias("address")).withColumn("key", building_key("address")), known)
        new.select("row_idx", "address", "key").write.mode("append").parquet(target)

    return candidates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_stream(events: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
