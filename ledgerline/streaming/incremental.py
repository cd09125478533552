"""Incremental rebuilds: what is missing or older than its source, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale(sources: DataFrame, built: DataFrame, key: str, modified: str = "modified") -> DataFrame:
    """key and state: missing where nothing was built, stale where the source is newer."""
    got = sources.select(key, F.col(modified).alias("_s")).join(built.select(key, F.col(modified).alias("_b")), key, "left")
    return got.where("_b is null or _s > _b").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("stale").alias("state"))


def changes(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Of a stream of (key, event time) the first row of each key and time, late ones within ``delay``."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key, at])


def windowed_counts(stream: DataFrame, key: str, at: str, width: str, delay: str) -> DataFrame:
    """Rows of each key by tumbling event-time window."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
