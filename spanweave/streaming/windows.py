"""Incremental twins of interval union and hit counts, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Unions of [at, at + gap) that touch or overlap, closed once the watermark passes: keys, s, e, n. The streaming form of an interval union."""
    grouped = stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n")


def dense_windows(stream: DataFrame, at: str, keys: list[str], width: str, slide: str, hits: int, late: str) -> DataFrame:
    """Sliding windows that hold at least `hits` events: keys, s, e, n."""
    grouped = stream.withWatermark(at, late).groupBy(*keys, F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return grouped.where(F.col("n") >= hits).select(*keys, F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n")
