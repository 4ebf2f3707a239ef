"""Structured Streaming forms of the event operators: sessions, repeats, resumable upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(stream: DataFrame, key: str, ts: str, gap_days: int = 3, late: str = "10 days") -> DataFrame:
    """Sessions of a key; stamps exactly gap_days apart are one, which the second added to the gap gives."""
    held = stream.withWatermark(ts, late)
    window = F.session_window(ts, f"{gap_days} days 1 second")
    return held.groupBy(key, window).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("session_window")


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: str = "10 days") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def hourly(stream: DataFrame, key: str, ts: str, value: str, late: str = "1 hour") -> DataFrame:
    by = stream.withWatermark(ts, late).groupBy(key, F.window(ts, "1 hour"))
    return by.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("hour"), "n", "total")


def upserts(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]):
    """Each batch is merged with what its own batch number has not yet written, so a replay writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        merge(batch, None).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
