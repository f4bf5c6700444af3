"""Incremental ingest of occurrences (an extra: rivers here are no data streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_occurrences(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows and distinct-free sums by tumbling window and group; windows close behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Visits: rows of a group without a gap longer than ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")
