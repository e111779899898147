"""Event-time windows that run alike on a table and on a stream (after :func:`with_event_time`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream's events with a watermark; the test tables' times have no zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """window_start, event_type, n and the sum of k."""
    k = F.get_json_object("props", "$.k").cast("int")
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "k")


def sliding(events: DataFrame, width: str = "3 days", step: str = "1 day") -> DataFrame:
    out = events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """A user's events at most *gap* apart, with the session's start and its end a gap after the last one."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
