"""Decisions and history as streams: an extension, with the same results as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(stream: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The latest value of each key so far; for output mode ``complete`` or ``update``."""
    return stream.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def activity(stream: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each kind in windows of event time; rows later than ``late`` don't count. A time without zone is taken as UTC."""
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    by = timed.groupBy(F.window("event_time", width), kind).agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), kind, "n")


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: rows no further apart than ``gap``."""
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late)
    by = timed.groupBy(F.session_window("event_time", gap), key).agg(F.count("*").alias("n"))
    return by.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, own: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each id once, within the watermark."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late).dropDuplicatesWithinWatermark([own])
