"""Sessions of a stream of events, closed by pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sessions(events: DataFrame, key: str, at: str, pause: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``key, session_start, session_end, events`` of each session; works on a stream, where rows later than ``late`` are dropped, and on a table alike."""
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    made = rows.groupBy(key, F.session_window("_at", pause).alias("w")).agg(F.count("*").alias("events"))
    return made.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
