"""Streaming forms: windowed activity, and first appearances of pairs kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, event_type, n, users) per tumbling window; `events` may be a stream, late rows beyond `delay` are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")


def first_seen(pairs: DataFrame) -> DataFrame:
    """(src, dst, first_ts): on a stream of pairs, the running minimum per pair (update mode)."""
    return pairs.groupBy("src", "dst").agg(F.min("ts").alias("first_ts"))
