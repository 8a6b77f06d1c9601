"""Ranks and running sums over all rows in order, without one task that holds them all."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltrace.operators.joins import looked_up
from siltrace.sources.stored import written


def cumulated(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds, for each of ``sums``, the sum over the rows before in ``order`` (within each of ``by``).

    Rows are dealt into ranges of the order, which is total; a row's sum is that of the ranges before its own, a table of one
    row for each range, and that of the rows before it within its range.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_at_{n}") for n in sums])
    own = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(starts, [*by, "_range"])
    found = {n: F.col(f"_at_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}
    return rows.select(*df.columns, *[c.alias(n) for n, c in found.items()])


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """(share, quantile): exact, between two order statistics by linear interpolation; null without values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    placed = cumulated(counts, [F.col(value)], {"_before": F.col("_n")})
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    asked = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    wanted = total.select(asked, "_all").withColumn("_at", (F.col("_all") - 1) * F.col("share"))
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    low = F.max(F.when(holds(F.floor("_at")), F.col(value)))
    high = F.max(F.when(holds(F.least(F.floor("_at") + 1, F.col("_all") - 1)), F.col(value)))
    met = placed.join(F.broadcast(wanted), holds(F.floor("_at")) | holds(F.least(F.floor("_at") + 1, F.col("_all") - 1)))  # a row for each share
    found = met.groupBy("share", "_at").agg(low.alias("_low"), high.alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    return wanted.select("share").join(found.select("share", between.alias("quantile")), "share", "left")


def quantiles_by(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by..., share, quantile) of each key's values: exact, between two order statistics by linear interpolation.

    Values are counted by key, and placed by the counts of ranges of the order: a key of any size is never in one buffer or task.
    Null values do not count and null keys have no row."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, value)])
    counts = df.filter(known).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = written(cumulated(counts, [F.col(value)], {"_before": F.col("_n")}, by), "placed-values")
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))
    # Of the shares in order, those that may end at a row, and a few beside them: found by a table over steps of equal width.
    own, steps = sorted({float(s) for s in shares}), len(shares)
    below = F.array(*[F.lit(bisect_left(own, k / steps)) for k in range(steps + 1)], F.lit(len(own)))
    step = lambda at: F.floor(at / F.greatest(F.col("_all") - 1, F.lit(1)) * steps)
    start = F.get(below, F.greatest(step(F.col("_before") - 1) - 1, F.lit(0)).cast("int"))
    end = F.get(below, F.least(step(F.col("_before") + F.col("_n")) + 2, F.lit(steps + 1)).cast("int"))
    asked = F.explode(F.slice(F.array(*[F.lit(s) for s in own]), start + 1, end - start)).alias("share")
    wanted = looked_up(placed, totals, by).select("*", asked).withColumn("_at", (F.col("_all") - 1) * F.col("share"))
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    low, high = holds(F.floor("_at")), holds(F.least(F.floor("_at") + 1, F.col("_all") - 1))
    found = wanted.filter(low | high).groupBy(*by, "share", "_at").agg(F.max(F.when(low, F.col(value))).alias("_low"), F.max(F.when(high, F.col(value))).alias("_high"))
    return found.select(*by, "share", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))
