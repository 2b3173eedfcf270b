"""Measurements as a stream: windowed medians of late-arriving observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window and key: count, mean, approximate median, maximum.  State is dropped once the watermark has passed
    a window; on a batch table it is the plain aggregation."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, width).alias("w"), *keys)
    summed = grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.5).alias("median"), F.max(value).alias("top"))
    return summed.select(F.col("w.start").alias("start"), *keys, "n", "mean", "median", "top")
