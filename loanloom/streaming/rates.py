"""Sliding event rates per key on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_rates(events: DataFrame, key: str, moment: str, *, window: str = "15 minutes", slide: str = "1 minute",
                  delay: str | None = "5 minutes") -> DataFrame:
    """Events per key and sliding window; windows close ``delay`` after their end.

    ``delay=None`` keeps the watermark that the stream already carries.
    Counts combine map-side, so a burst of one key costs each task one row per window.
    """
    marked = events.withWatermark(moment, delay) if delay else events
    return (
        marked.groupBy(F.window(moment, window, slide), key)
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def breaches(events: DataFrame, key: str, moment: str, limit: int, **options: str | None) -> DataFrame:
    rates = sliding_rates(events, key, moment, **options)
    return rates.where(F.col("n_events") >= limit).select(
        key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_events"
    )
