"""Churn of files while commits arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn(touches: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, file_path, touches, last) by file and window of commit time, from a stream of
    touches(ts, file_path). State is kept until the watermark passes a window; what comes later
    than ``late`` is left out."""
    g = touches.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "file_path")
    return g.agg(F.count(F.lit(1)).alias("touches"), F.max("ts").alias("last")).select(F.col("w.start").alias("start"), "file_path", "touches", "last")
