"""Event-time windows for batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """start, event_type, n: tumbling one-hour counts; ``late`` sets a watermark on a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
