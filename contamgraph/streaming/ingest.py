"""Incremental ingest beyond the batch contract: event counts under a watermark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events a type and tumbling window; batch or stream alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def edges_of_events(events: DataFrame) -> DataFrame:
    """Events as edges user to event type, one a (user, type), with their first time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.concat(F.lit("user:"), "user_id").alias("src"), F.concat(F.lit("type:"), "event_type").alias("dst")).agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))
