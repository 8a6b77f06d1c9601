"""Control charts on a stream: event-time windows as subgroups, limits from a fixed baseline.

Counts are watermarked window aggregates, so that state is bounded by the watermark; the limits are the p-chart's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_shares(stream: DataFrame, pattern: str, time_col: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, n, count) of each event-time window; rows later than the watermark are dropped by Spark."""
    hit = (F.col("y_pred") == pattern).cast("int")
    return (
        stream.withWatermark(time_col, late)
        .groupBy(F.window(time_col, width).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(hit).alias("count"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "count")
    )


def beyond_limits(shares: DataFrame, center: float, sigma_z: float = 1.0) -> DataFrame:
    """Adds value, z, alarm (|z| > 3) against a baseline share; works on batches and on streams."""
    sigma = F.sqrt(F.lit(center * (1 - center)) / F.col("n")) * sigma_z
    z = F.try_divide(F.col("count") / F.col("n") - center, sigma)
    return shares.withColumns({"value": F.col("count") / F.col("n"), "z": z}).withColumn("alarm", F.coalesce(F.abs("z") > 3, F.lit(False)))
