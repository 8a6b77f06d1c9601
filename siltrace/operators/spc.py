"""Statistical process control charts over an ordered stream of predictions.

Rows are numbered over ranges of their order, so that no task sorts the whole stream.  One pass over them counts blocks of the
smallest subgroup size; that table is written, and everything after it works on it.  Everything that looks along a chart works on
ranges of its places (:mod:`siltrace.operators.scans`): rules with a halo of the last seven points, EWMA and groups of whole lots
with states that pass from range to range.  Charts are few, as they come from a list of classes; their limits are a broadcast table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltrace.functions.columns import clip
from siltrace.operators.ranks import cumulated
from siltrace.operators.scans import entry_states, own_rows, range_window, with_halo
from siltrace.sources.stored import written

RULES = ("R1", "R2", "R3", "R4", "EWMA")
RUN_BLOCK = 4096  # runs of lots that one task merges
LAMBDA, LIMIT, D2, MIN_EXPECTED = 0.2, 2.7, 1.128, 5.0


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Adds ``name``, the row's place from 0 in the total order ``order``."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return cumulated(df, columns, {name: F.lit(1).cast("long")})


def fixed_groups(rows: DataFrame, size: Column, total: Column) -> DataFrame:
    """Adds gid = idx div size; -1 for a last group of less than half the size."""
    tail = total % size
    short = (tail > 0) & (2 * tail < size) & (F.col("idx") >= total - tail)
    return rows.withColumn("gid", F.when(short, F.lit(-1)).otherwise(F.floor(F.col("idx") / size)).cast("long"))


def with_runs(rows: DataFrame, lot: str = "lot") -> DataFrame:
    """Adds run, the number from 0 of the row's run of consecutive rows of one lot, to rows with idx.

    A row begins a run if the row before has another lot; begins are counted over ranges of idx."""
    seen = with_halo(rows, "idx", before=1)
    before = F.lag(F.struct(F.col(lot).alias("l"))).over(range_window("idx"))
    begins = (F.col("idx") == 0) | ~F.col("_before.l").eqNullSafe(F.col(lot))
    marked = own_rows(seen.withColumn("_before", before).withColumn("_begins", begins.cast("long"))).drop("_before")
    counted = cumulated(marked, [F.col("idx")], {"run": F.col("_begins")})
    return counted.withColumn("run", F.col("run") + F.col("_begins") - 1).drop("_begins")


def runs_of(rows: DataFrame, lot: str = "lot") -> DataFrame:
    """(run, first_idx, size, lot) from rows with run."""
    return rows.groupBy("run", lot).agg(F.min("idx").alias("first_idx"), F.count("*").alias("size")).select("run", "first_idx", "size", lot)


def lot_runs(rows: DataFrame, lot: str = "lot") -> DataFrame:
    """(run, first_idx, size, lot) of consecutive rows of one lot, from rows with idx."""
    return runs_of(with_runs(rows, lot), lot)


def _merged(sizes: np.ndarray, target: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs merged in order from several starting fills ``held`` at once: (groups closed before each run, closed, fill at the end)."""
    before, closed = np.zeros((len(sizes), len(held)), np.int64), np.zeros(len(held), np.int64)
    for i, size in enumerate(sizes):
        before[i] = closed
        held = held + size
        full = held >= target
        closed = closed + full
        held = np.where(full, 0, held)
    return before, closed, held


def lot_groups(runs: DataFrame, target: int) -> DataFrame:
    """(run, gid): runs merged in order until a group has ``target`` rows; -1 for a last group of less than half of that.

    How a block of runs is merged depends on its predecessors only through the rows that the open group holds when it begins,
    a number below ``target``.  Every block is merged from all of these at once; composing the blocks' outcomes gives each its
    beginning, from which its groups are numbered.
    """
    parts = runs.select(F.floor(F.col("run") / RUN_BLOCK).alias("range"), "run", "size")

    def outcomes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table.sort_by("run")["size"].to_numpy()
        _, closed, held = _merged(sizes, target, np.arange(target))
        return pa.table({"range": [key[0].as_py()], "counts": pa.array([closed.tolist()], pa.list_(pa.int64())), "after": pa.array([held.tolist()], pa.list_(pa.int64()))})

    ends = parts.groupBy("range").applyInArrow(outcomes, "range long, counts array<long>, after array<long>")
    begins, last, rest = entry_states(written(ends, "merged-blocks"), target)

    def numbered_runs(_key: tuple[pa.Scalar, ...], table: pa.Table, begin: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        before, _, _ = _merged(table["size"].to_numpy(), target, begin["state"].to_numpy()[:1])
        gid = before[:, 0] + begin["count"][0].as_py()
        short = (gid == last) & (2 * rest < target)
        return pa.table({"run": table["run"], "gid": np.where(short, -1, gid)})

    return parts.groupBy("range").cogroup(begins.groupBy("range")).applyInArrow(numbered_runs, "run long, gid long")


def chart_rows(rows: DataFrame, classes: Sequence[str], conf_threshold: float = 0.7, *keep: str) -> DataFrame:
    """(chart, idx, lot, hit, keep...): one row for each row and watched class, and LOW_CONFIDENCE where a confidence is there."""
    watched = [F.struct(F.lit(c).alias("chart"), (F.col("y_pred") == c).cast("int").alias("hit")) for c in classes]
    if "confidence" in rows.columns:
        watched.append(F.struct(F.lit("LOW_CONFIDENCE").alias("chart"), (F.col("confidence") < conf_threshold).cast("int").alias("hit")))
    return rows.select("idx", "lot", *keep, F.inline(F.array(*watched)))


def adaptive_sizes(hits: DataFrame, base_size: int, n_base_rows: int) -> DataFrame:
    """(chart, size, total): the multiple of base_size at which five hits are expected; charts without baseline hits drop out."""
    return _sizes(hits.groupBy("chart").agg(F.avg(F.when(F.col("idx") < n_base_rows, F.col("hit"))).alias("p0"), (F.max("idx") + 1).alias("total")), base_size)


def _sizes(stats: DataFrame, base_size: int) -> DataFrame:
    size = F.ceil(MIN_EXPECTED / F.col("p0") / base_size) * base_size
    return stats.filter("p0 > 0").select("chart", size.cast("long").alias("size"), "total")


def subgroups(grouped: DataFrame) -> DataFrame:
    """(chart, gid, n, count, end_idx, lots) from (chart, gid, idx, lot, hit); lots names the first three."""
    return _joined_lots(grouped.select("chart", "gid", "lot", F.lit(1).cast("long").alias("n"), "hit", F.col("idx").alias("first"), F.col("idx").alias("last")))


def _joined_lots(parts: DataFrame) -> DataFrame:
    """Subgroups from parts of them: (chart, gid, lot, n, hit, first, last)."""
    sums = [F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("last").alias("last"), F.min("first").alias("first")]
    firsts = parts.filter("gid >= 0").groupBy("chart", "gid", "lot").agg(*sums)
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "lot"))), lambda s: s["lot"])
    return firsts.groupBy("chart", "gid").agg(
        F.sum("n").alias("n"),
        F.sum("hit").alias("count"),
        F.max("last").alias("end_idx"),
        F.concat(F.array_join(F.slice(names, 1, 3), ","), F.when(F.size(names) > 3, "…").otherwise("")).alias("lots"),
    )


def with_baseline(groups: DataFrame, n_base_rows: int) -> DataFrame:
    """Adds i (place from 0 in the chart), n_base (groups that end in the baseline rows, three at least) and n_groups.

    gid counts from 0 without gaps in each chart, as those of whole subgroups do."""
    stats = groups.groupBy("chart").agg(F.count_if(F.col("end_idx") < n_base_rows).alias("n_base"), F.count("*").alias("n_groups"))
    stats = stats.withColumn("n_base", F.greatest(F.lit(3), F.col("n_base")))
    return groups.join(F.broadcast(stats), "chart").withColumn("i", F.col("gid"))


def _steps(points: DataFrame, value: str) -> DataFrame:
    """(chart, step): the mean absolute difference of neighbours in each chart's baseline."""
    base = points.filter(F.col("i") < F.col("n_base")).select("chart", "i", value)
    seen = with_halo(base, "i", before=1)
    step = F.abs(F.col(value) - F.lag(value).over(range_window("i", ["chart"])))
    return own_rows(seen.withColumn("step", step)).groupBy("chart").agg(F.avg("step").alias("step"))


def p_chart(groups: DataFrame, laney: bool = True) -> DataFrame:
    """Adds value, center, sigma, sigma_z, z, ucl, lcl from groups with n, count, i, n_base; charts whose baseline share is 0 or 1 drop out."""
    base = F.col("i") < F.col("n_base")
    own = groups.filter(base).groupBy("chart").agg((F.sum("count") / F.sum("n")).alias("center"), F.count("*").alias("_held"))
    raw = groups.join(F.broadcast(own.filter("center > 0 AND center < 1")), "chart").withColumn("value", F.col("count") / F.col("n"))
    raw = raw.withColumn("s0", F.sqrt(F.col("center") * (1 - F.col("center")) / F.col("n")))
    raw = raw.withColumn("z0", (F.col("value") - F.col("center")) / F.col("s0"))
    if laney:
        raw = raw.join(F.broadcast(_steps(raw, "z0")), "chart")
        factor = F.when(F.col("_held") >= 3, F.greatest(F.lit(1.0), F.col("step") / D2)).otherwise(1.0)
    else:
        raw, factor = raw.withColumn("step", F.lit(None)), F.lit(1.0)
    out = raw.withColumn("sigma_z", factor).withColumn("sigma", F.col("s0") * F.col("sigma_z"))
    return out.withColumns(
        {
            "z": (F.col("value") - F.col("center")) / F.col("sigma"),
            "ucl": clip(F.col("center") + 3 * F.col("sigma"), 0.0, 1.0),
            "lcl": clip(F.col("center") - 3 * F.col("sigma"), 0.0, 1.0),
        }
    ).drop("s0", "z0", "step", "_held")


def mean_chart(groups: DataFrame, value: str = "value") -> DataFrame:
    """Individuals chart of group means: sigma is the baseline's mean moving range / 1.128; empty below three baseline groups."""
    named = groups.withColumn("value", F.col(value))
    base = named.filter(F.col("i") < F.col("n_base")).groupBy("chart").agg(F.avg("value").alias("center"), F.count("*").alias("_held"))
    limits = base.join(_steps(named, "value"), "chart").withColumn("sigma", F.col("step") / D2).filter("_held >= 3 AND sigma > 0")
    own = named.join(F.broadcast(limits.select("chart", "center", "sigma")), "chart")
    return own.withColumns(
        {
            "sigma_z": F.lit(1.0),
            "z": (F.col("value") - F.col("center")) / F.col("sigma"),
            "ucl": F.col("center") + 3 * F.col("sigma"),
            "lcl": F.col("center") - 3 * F.col("sigma"),
        }
    )


def western_electric(points: DataFrame, key: str = "chart", order: str = "i", z: str = "z") -> DataFrame:
    """Adds R1..R4: one point beyond 3; 2 of 3 beyond 2, 4 of 5 beyond 1, 8 of 8 beyond 0 on one side, in full windows only.

    ``order`` counts from 0 without gaps in each chart."""
    w = range_window(order, [key])

    def run(length: int, least: int, beyond: float) -> Column:
        own = w.rowsBetween(-(length - 1), 0)
        count = lambda c: F.sum(c.cast("int")).over(own)
        full = F.count("*").over(own) == length
        return full & ((count(F.col(z) > beyond) >= least) | (count(F.col(z) < -beyond) >= least))

    rules = {"R1": F.abs(z) > 3, "R2": run(3, 2, 2.0), "R3": run(5, 4, 1.0), "R4": run(8, 8, 0.0)}
    return own_rows(with_halo(points, order, before=7).withColumns(rules))


def ewma(points: DataFrame, key: str = "chart", order: str = "i", z: str = "z", lam: float = LAMBDA, limit: float = LIMIT) -> DataFrame:
    """(key, order, ewma, ewma_limit): the recurrence e = lam * z + (1 - lam) * e over each chart's ordered groups, from e = 0.

    ``order`` counts from 0 without gaps.  Within a block of groups the recurrence is a weighted prefix sum; a block begins
    with what the blocks before it leave, of which all but the last few have decayed below the precision of a double.
    """
    keep = 1.0 - lam
    length = max(1, ceil(log(1e-6) / log(keep))) if 0 < keep < 1 else 1
    place = F.col(order)
    rows = points.select(key, order, z).withColumn("_b", F.floor(place / length)).withColumn("_k", place % length)
    w = Window.partitionBy(key, "_b").orderBy(order)
    power = lambda c: F.pow(F.lit(keep), c)
    rows = rows.withColumn("_e", power(F.col("_k")) * F.sum(lam * F.col(z) * power(-F.col("_k"))).over(w))
    left = rows.filter(F.col("_k") == length - 1)
    later = F.explode(F.array(*[F.struct((F.col("_b") + m).alias("_b"), F.lit(keep ** (length * (m - 1))).alias("_w")) for m in range(1, 5)])).alias("t")
    begin = left.select(key, "_e", later).groupBy(key, F.col("t._b").alias("_b")).agg(F.sum(F.col("_e") * F.col("t._w")).alias("_begin"))
    value = F.col("_e") + power(F.col("_k") + 1) * F.coalesce("_begin", F.lit(0.0))
    bound = limit * F.sqrt(lam / (2 - lam) * (1 - power(2.0 * (place + 1))))
    return rows.join(begin, [key, "_b"], "left").select(key, order, value.alias("ewma"), bound.alias("ewma_limit"))


def finished(points: DataFrame) -> DataFrame:
    """All five rules of a chart's points."""
    both = western_electric(points).join(ewma(points.select("chart", "i", "z")), ["chart", "i"])
    return both.withColumn("above_ewma", F.abs("ewma") > F.col("ewma_limit"))


def counted_blocks(rows: DataFrame, classes: Sequence[str], base_size: int, n_base_rows: int, conf_threshold: float = 0.7, block: Column | None = None) -> DataFrame:
    """(chart, block, lot, n, hit, first, last, n_start, hit_start) of each block of ``base_size`` numbered rows, or of a given
    block: the only pass over the stream.  *_start count the rows of the baseline."""
    start = F.col("idx") < n_base_rows
    hits = chart_rows(rows if block is None else rows.withColumn("block", block), classes, conf_threshold, *([] if block is None else ["block"]))
    own = F.floor(F.col("idx") / base_size) if block is None else F.col("block")
    return hits.groupBy("chart", own.alias("block"), "lot").agg(
        F.count("*").alias("n"),
        F.sum("hit").alias("hit"),
        F.min("idx").alias("first"),
        F.max("idx").alias("last"),
        F.count_if(start).alias("n_start"),
        F.sum(F.when(start, F.col("hit")).otherwise(0)).alias("hit_start"),
    )


def build_charts(
    rows: DataFrame,
    classes: Sequence[str],
    base_size: int = 25,
    n_base_rows: int = 2500,
    conf_threshold: float = 0.7,
    laney: bool = True,
    by_lot: bool = False,
) -> DataFrame:
    """All charts of numbered rows (idx, lot, y_pred[, confidence, fail_frac]): long table of finished points.

    Subgroups hold the multiple of ``base_size`` rows at which five hits are expected, each chart its own; or, ``by_lot``,
    whole runs of lots merged until they hold as many.
    """
    if by_lot:
        rows = written(with_runs(rows), "rows-of-runs")
        runs = written(runs_of(rows), "lot-runs")
    blocks = written(counted_blocks(rows, classes, base_size, n_base_rows, conf_threshold, F.col("run") if by_lot else None), "blocks")
    stats = blocks.groupBy("chart").agg(F.try_divide(F.sum("hit_start").cast("double"), F.sum("n_start").cast("double")).alias("p0"), (F.max("last") + 1).alias("total"))
    sizes = written(_sizes(stats, base_size), "sizes")
    placed = blocks.join(F.broadcast(sizes), "chart")
    if by_lot:
        wanted = sorted({r["size"] for r in sizes.select("size").distinct().collect()})  # at most one for each chart
        parts = [placed.filter(F.col("size") == n).join(_gids(runs, n), F.col("block") == F.col("run")) for n in wanted]
        grouped = reduce(DataFrame.unionByName, parts) if parts else placed.withColumn("gid", F.col("block")).limit(0)
    else:
        grouped = fixed_groups(placed.withColumn("idx", F.col("block") * base_size), F.col("size"), F.col("total"))
    groups = with_baseline(written(_joined_lots(grouped), "subgroups"), n_base_rows)
    charts = p_chart(groups.filter("n_groups - n_base >= 2"), laney).withColumn("kind", F.lit("p"))
    if "fail_frac" in rows.columns:
        if by_lot:
            cells = rows.join(_gids(runs, base_size), "run")
        else:
            total = rows.agg((F.max("idx") + 1).alias("total"))
            cells = fixed_groups(rows.crossJoin(F.broadcast(total)), F.lit(base_size), F.col("total"))
        means = cells.filter("gid >= 0").groupBy(F.lit("FAIL_FRAC_MEAN").alias("chart"), "gid").agg(
            F.count("*").alias("n"), F.max("idx").alias("end_idx"), F.avg("fail_frac").alias("value")
        )
        own = mean_chart(with_baseline(written(means, "means"), n_base_rows)).withColumn("kind", F.lit("mean"))
        charts = charts.unionByName(own, allowMissingColumns=True)
    return finished(written(charts, "chart-points"))


def _gids(runs: DataFrame, target: int) -> DataFrame:
    return written(lot_groups(runs, target), "lot-groups")


def alarms(points: DataFrame) -> DataFrame:
    """(chart, subgroup, end_idx, phase, rule, value, z, direction): a row for each rule that a point completes."""
    flags = F.array(*[F.struct(F.lit(r).alias("rule"), F.col("above_ewma" if r == "EWMA" else r).alias("on")) for r in RULES])
    rows = points.select("chart", F.col("i").alias("subgroup"), "end_idx", "value", "z", "n_base", F.inline(flags)).filter("on")
    return rows.select(
        "chart", "subgroup", "end_idx", F.when(F.col("subgroup") < F.col("n_base"), "baseline").otherwise("monitor").alias("phase"),
        "rule", "value", "z", F.when(F.col("z") > 0, "up").otherwise("down").alias("direction"),
    )


def first_detection(found: DataFrame) -> DataFrame:
    """(chart, rule, first_idx) in the monitored phase."""
    return found.filter("phase = 'monitor'").groupBy("chart", "rule").agg(F.min("end_idx").alias("first_idx"))


def rule_pivot(first: DataFrame) -> DataFrame:
    """(chart, R1..R4, EWMA): first places as text, '-' where none."""
    wide = first.groupBy("chart").pivot("rule", list(RULES)).agg(F.min("first_idx"))
    return wide.select("chart", *[F.coalesce(F.col(r).cast("string"), F.lit("-")).alias(r) for r in RULES])


def baseline_alarm_rate(points: DataFrame, found: DataFrame) -> DataFrame:
    """(alarms, groups, rate, warn): alarms in the baseline against its groups; above 5 % the baseline is not in control."""
    groups = points.groupBy("chart").agg(F.max("n_base").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("groups"))
    count = found.agg(F.count_if(F.col("phase") == "baseline").alias("alarms"))
    rate = F.try_divide(F.col("alarms").cast("double"), F.col("groups").cast("double"))
    return count.crossJoin(F.broadcast(groups)).select("alarms", "groups", rate.alias("rate"), (rate > 0.05).alias("warn"))
