"""The monthly figures over a stream: watermarked windows whose parts are the same additive sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwell.operators.analytics import Scale, metrics, parts


def windowed_metrics(stream: DataFrame, time_col: str, sentiment_col: str = "sentiment", weight_col: str | None = None, window: str = "30 days", late: str = "2 days", by: str | None = None, scale: Scale = Scale()) -> DataFrame:
    """Metrics of each time window, and group, of a stream or a table; rows later than the watermark are dropped by the stream."""
    keys = [F.window(time_col, window).alias("span"), *([F.col(by).alias("group")] if by else [])]
    sums = stream.withWatermark(time_col, late).groupBy(*keys).agg(*parts(stream, sentiment_col, weight_col, scale))
    return sums.select(F.col("span.start").alias("window_start"), *(["group"] if by else []), *metrics())


def first_submissions(stream: DataFrame, time_col: str, keys: list[str], late: str = "2 days") -> DataFrame:
    """The stream without repeats of ``keys`` within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)
