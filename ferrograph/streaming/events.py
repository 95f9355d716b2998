"""Profiles of a stream of events, in batch and incrementally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

AGGREGATES = ("n", "total", "least", "most")


def _aggregates() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most")]


def hourly(events: DataFrame) -> DataFrame:
    """hour, event_type, n, users, total, least, most of a table of (ts, event_type, user_id, value)."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(*_aggregates(), F.countDistinct("user_id").alias("users"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same of a stream, with a watermark; users are counted by a sketch, since a stream can't keep distinct values exactly."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(*_aggregates(), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("hour"), "event_type", *AGGREGATES, "users")


def profile_stream(events: DataFrame, path: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Append each closed window to Parquet under `path`; restarts go on from `checkpoint`."""
    out = windowed(events, width, late)
    return out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
