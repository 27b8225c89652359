"""Slides discovered as they arrive in a landing folder (an extension: batch relations kept by Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """A stream of ``path, length, modified`` of new files; contents aren't read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    stream = files.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return stream.select("path", "length", F.col("modificationTime").alias("modified"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; rows later than ``late`` are left out of closed windows (streams only)."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), key, "events")
