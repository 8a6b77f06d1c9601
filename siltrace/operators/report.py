"""Tables behind reports and plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.sources.dimensions import ACTIONS, mapped


def lot_summary(wafers: DataFrame) -> DataFrame:
    """(lot, n_wafers, mean_yield, min_yield, top_pattern, top_count, match_rate, verdict) from (lot, pattern, yield_pct, matched).

    The most frequent pattern, ties by name; below 90 % mean yield the lot is to be reviewed.
    """
    counts = wafers.groupBy("lot", "pattern").agg(
        F.count("*").alias("n"), F.sum("yield_pct").alias("y"), F.min("yield_pct").alias("low"), F.sum(F.col("matched").cast("int")).alias("ok")
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "pattern"))
    return counts.groupBy("lot").agg(
        F.sum("n").alias("n_wafers"), (F.sum("y") / F.sum("n")).alias("mean_yield"), F.min("low").alias("min_yield"), best.alias("best"), (F.sum("ok") / F.sum("n")).alias("match_rate")
    ).select(
        "lot", "n_wafers", "mean_yield", "min_yield", F.col("best.pattern").alias("top_pattern"), (-F.col("best.n")).alias("top_count"), "match_rate",
        F.when(F.col("mean_yield") < 90, "review").otherwise("ok").alias("verdict"),
    )


def with_actions(df: DataFrame, pattern: str = "y_pred") -> DataFrame:
    return df.withColumn("action", mapped(ACTIONS, F.col(pattern)))


def title_stats(yields: DataFrame, verdicts: DataFrame, id_col: str = "wafer") -> DataFrame:
    """What a wafer plot's title says: dies, fails, yield, pattern."""
    return yields.join(verdicts, id_col).select(id_col, "n_die", "n_fail", "yield_pct", "y_pred")
