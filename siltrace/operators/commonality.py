"""Which tool do the lots with a rising pattern share?  One-sided rank tests by (step, tool), adjusted for their number."""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil, comb, lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltrace.functions.columns import normal_tail, ratio
from siltrace.sources.stored import written

MIN_LOTS, ALPHA = 5, 0.05
SMALL_SIDE = 8  # lots, up to which a side without ties has an exact test


@cache
def _bounded_sums(m: int) -> tuple[int, list[int]]:
    """(L, N): 1 / ((1 - q) * (1 - q) * (1 - q**2) ... (1 - q**m)) = N(q) / (1 - q**L) ** (m + 1)."""
    period = lcm(*range(1, m + 1))
    out = [1]
    for step in (1, *range(1, m + 1)):
        terms = period // step  # times 1 + q**step + ... + q**(period - step)
        longer = out + [0] * (period - step)
        for k in range(step, len(longer)):
            longer[k] += longer[k - step]
        out = [x - (longer[k - terms * step] if k >= terms * step else 0) for k, x in enumerate(longer)]
    return period, out


def rank_sum_tail(u: float, m: int, n: int) -> float:
    """P(U >= u) of the rank statistic of m and n values without ties, of which the smaller number is small.

    The orders that give each U are the coefficients of the Gaussian binomial, the product over i = 1..m of
    (1 - q**(n + i)) / (1 - q**i).  Its numerator has 2**m terms, and the sums of the denominator's coefficients up to any place follow
    from m + 1 binomials: whole numbers of any size, so that neither memory nor precision depends on n.
    """
    m, n = min(m, n), max(m, n)
    period, head = _bounded_sums(m)

    def up_to(place: int) -> int:
        return sum(head[j] * comb((place - j) // period + m, m) for j in range(place % period, min(place + 1, len(head)), period))

    last = m * n - max(0, ceil(u))  # U is symmetric: as likely at least u as at most m * n - u
    if last < 0:
        return 0.0
    ways = 0
    for size in range(m + 1):
        for chosen in combinations(range(n + 1, n + m + 1), size):
            if (left := last - sum(chosen)) >= 0:
                ways += (-1) ** size * up_to(left)
    return ways / comb(m + n, m)


@F.pandas_udf(T.DoubleType())
def exact_tail(u: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    """:func:`rank_sum_tail` by row, of a table with a row for each tool; null where both sides are larger than eight."""
    return pd.Series([rank_sum_tail(a, int(b), int(c)) if min(b, c) <= SMALL_SIDE else None for a, b, c in zip(u, m, n, strict=True)], dtype="float64")


def lot_rates(predictions: DataFrame, pattern: str | None = None, hit: str | None = None) -> DataFrame:
    """(lot, n_wafers, rate) of the wafers with a pattern, or with a given flag; the lot is the unit of the tests."""
    flag = F.col(hit) if hit else F.col("y_pred") == pattern
    return predictions.groupBy("lot").agg(F.count("*").alias("n_wafers"), F.avg(flag.cast("double")).alias("rate"))


def bh_adjust(df: DataFrame, p: str = "p", key: tuple[str, ...] = ("step", "tool")) -> DataFrame:
    """Adds p_adj (Benjamini-Hochberg); null p stay null and do not count.  The table has a row for each tool."""
    tested = df.filter(F.col(p).isNotNull())
    up = Window.orderBy(p, *key)
    ranked = tested.withColumns({"_m": F.count("*").over(Window.partitionBy()), "_k": F.row_number().over(up)})
    raw = F.col(p) * F.col("_m") / F.col("_k")
    down = Window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = ranked.withColumn("p_adj", F.least(F.min(raw).over(down), F.lit(1.0))).drop("_m", "_k")
    return adjusted.unionByName(df.filter(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double")))


def commonality(rates: DataFrame, history: DataFrame, min_lots: int = MIN_LOTS) -> DataFrame:
    """(step, tool, n_lots, n_others, rate_through, rate_others, delta, u, z, p, p_adj) for each step and tool.

    Others are the lots that visited the step on another tool.  As a tool's lots and its others are always the step's lots,
    ranks are taken once a step, from counts of its distinct rates.  The rank test is exact where a side has at most eight lots
    and no rates are equal, however many the other has, else the normal approximation with tie and continuity corrections; p is null below ``min_lots`` on a side or where all rates are equal.
    """
    visits = history.select("lot", "step", "tool").join(rates.select("lot", "rate"), "lot")
    tools = visits.groupBy("step", "tool", "rate").agg(F.count("*").alias("n"))
    by_rate = tools.groupBy("step", "rate").agg(F.sum("n").alias("c"))
    w = Window.partitionBy("step").orderBy("rate")
    below = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_rate.withColumn("rank", below + (F.col("c") + 1) / 2.0)
    steps = by_rate.groupBy("step").agg(
        F.sum("c").alias("total"), F.sum(F.col("c") * F.col("rate")).alias("rates"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"), F.count("*").alias("kinds")
    )
    sums = tools.join(ranked.select("step", "rate", "rank"), ["step", "rate"]).groupBy("step", "tool").agg(
        F.sum("n").alias("n_lots"), F.sum(F.col("n") * F.col("rate")).alias("own"), F.sum(F.col("n") * F.col("rank")).alias("ranks")
    )
    t = sums.join(steps, "step").withColumn("n_others", F.col("total") - F.col("n_lots"))
    n1, n0, n = F.col("n_lots").cast("double"), F.col("n_others").cast("double"), F.col("total").cast("double")
    t = t.withColumns({"rate_through": F.col("own") / n1, "rate_others": ratio(F.col("rates") - F.col("own"), n0), "u": F.col("ranks") - n1 * (n1 + 1) / 2})
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.try_divide(F.col("ties").cast("double"), n * (n - 1))))
    judged = (F.col("n_lots") >= min_lots) & (F.col("n_others") >= min_lots) & (F.col("kinds") > 1)
    z = F.when(judged, F.try_divide(F.col("u") - n1 * n0 / 2.0 - 0.5, spread))
    small = judged & (F.col("ties") == 0) & (F.least(n1, n0) <= SMALL_SIDE)
    p = F.when(small, exact_tail("u", "n_lots", "n_others")).otherwise(normal_tail(F.col("z")))
    t = t.withColumn("z", z).withColumn("p", p).withColumn("delta", F.col("rate_through") - F.col("rate_others"))
    names = ["step", "tool", "n_lots", "n_others", "rate_through", "rate_others", "delta", "u", "z", "p"]
    return bh_adjust(t.select(*names))


def ranked_candidates(table: DataFrame) -> DataFrame:
    """Adds place (from 1): by p_adj, then the larger delta, untested ones last."""
    order = [F.asc_nulls_last(F.round("p_adj", 12)), F.desc_nulls_last(F.round("delta", 9)), "step", "tool"]
    return table.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def confounding(rates: DataFrame, history: DataFrame, table: DataFrame, alpha: float = ALPHA, min_lots: int = MIN_LOTS) -> DataFrame:
    """Adds confounded_with: significant tools that are no longer so among the lots that the top candidate never saw.

    Empty for tools that stay significant, for the top candidate, and where fewer than two are significant or too few lots
    are left to test.
    """
    placed = written(ranked_candidates(table), "candidates")
    significant = placed.filter(F.col("p_adj") < alpha)
    head = significant.filter("place = 1").select(F.col("step").alias("s"), F.col("tool").alias("t"))
    seen = history.join(F.broadcast(head), (F.col("step") == F.col("s")) & (F.col("tool") == F.col("t"))).select("lot").distinct()
    rest = written(rates.join(seen, "lot", "left_anti"), "unseen")
    again = written(commonality(rest, history, min_lots), "retested").select("step", "tool", F.col("p_adj").alias("p_rest"), F.lit(True).alias("tested"))
    counts = rest.agg(F.count("*").alias("n_rest")).crossJoin(significant.agg(F.count("*").alias("n_significant")))
    judged = placed.join(again, ["step", "tool"], "left").crossJoin(F.broadcast(counts)).join(F.broadcast(head), F.lit(True), "left")
    asked = (F.col("n_significant") >= 2) & (F.col("n_rest") >= 2 * min_lots) & (F.col("p_adj") < alpha) & (F.col("place") > 1)
    name = F.concat_ws("/", "s", "t")
    note = F.when(F.col("tested").isNull(), F.concat(name, F.lit(" (no lots)"))).when(F.col("p_rest").isNull() | (F.col("p_rest") >= alpha), name)
    found = F.when(asked, F.coalesce(note, F.lit(""))).otherwise("")
    return judged.withColumn("confounded_with", found).select(*table.columns, "place", "confounded_with")


def verdicts(table: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds verdict: held, not significant, independent or confounded."""
    verdict = (
        F.when(F.col("p").isNull(), "held")
        .when(F.col("p_adj") >= alpha, "not significant")
        .when(F.col("confounded_with") == "", "independent")
        .otherwise("confounded")
    )
    return table.withColumn("verdict", verdict)


def tool_rates(rates: DataFrame, history: DataFrame, table: DataFrame, steps: int = 3) -> DataFrame:
    """(step, tool, lot, rate) of the first steps in order of significance, for plots by tool."""
    first = ranked_candidates(table).groupBy("step").agg(F.min("place").alias("place")).orderBy("place").limit(steps)
    return history.join(F.broadcast(first.select("step")), "step").join(rates, "lot").select("step", "tool", "lot", "rate")
