"""Contracts over streams: running counts of a contract's checks, for results that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, column: str, ts: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows, nulls and the range of a column by window of event time; a window is final once the watermark has passed it."""
    by = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"))
    out = by.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(column).isNull()).alias("null_count"), F.min(column).alias("least"), F.max(column).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), "row_count", "null_count", "least", "most")
