"""Die tables: maps to rows and back, geometry, yields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltrace.functions.columns import norm2

MIN_DIE = 100


def die_cells(maps: DataFrame, id_col: str = "wafer", map_col: str = "wafer_map") -> DataFrame:
    """(id, height, width, x, y, v) of the dies of nested maps; cells without a die are dropped, extra columns kept."""
    rest = [c for c in maps.columns if c not in (id_col, map_col)]
    m = F.col(map_col)
    rows = maps.select(id_col, *rest, F.size(m).alias("height"), F.size(F.try_element_at(m, F.lit(1))).alias("width"), F.posexplode(m).alias("y", "row"))
    cells = rows.select(id_col, *rest, "height", "width", "y", F.posexplode("row").alias("x", "v"))
    return cells.filter("v > 0")


def die_positions(cells: DataFrame, die_size: float = 10.0) -> DataFrame:
    """Adds die_x, die_y, radius, angle_deg, status: coordinates about the centre of the array, y upwards."""
    dx = (F.col("x") - (F.col("width") - 1) / 2.0) * die_size
    dy = ((F.col("height") - 1) / 2.0 - F.col("y")) * die_size
    return cells.withColumns({"die_x": dx, "die_y": dy}).withColumns(
        {
            "radius": norm2(F.col("die_x"), F.col("die_y")),
            "angle_deg": F.degrees(F.atan2("die_y", "die_x")),
            "status": F.when(F.col("v") == 2, "FAIL").otherwise("PASS"),
        }
    )


def die_map(cells: DataFrame, id_col: str = "wafer", carry: Sequence[str] = ()) -> DataFrame:
    """Nested maps (id, carry..., wafer_map) from die rows (id, height, width, x, y, v); places without a die are 0, dies at the same place
    or without one an error.

    carry: columns that all dies of a wafer share.  A wafer's dies are gathered as numbers, put in order, and the gaps between them
    filled: the work grows with the cells of a map, not with cells times dies."""
    size = F.col("height").cast("long") * F.col("width")
    place = F.col("y").cast("long") * F.col("width") + F.col("x")
    placed = F.coalesce(place, F.when(place.isNull(), F.raise_error(F.lit("a die without a place"))).cast("long"))
    packed = F.shiftleft(placed, 8) + F.coalesce(F.col("v").cast("tinyint").cast("long"), F.lit(0)) + 128
    grouped = cells.groupBy(id_col, *carry, "height", "width").agg(F.sort_array(F.collect_list(packed)).alias("dies"))
    held = F.filter("dies", lambda d: (d >= 0) & (F.shiftright(d, 8) < size))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("tinyint"), n.cast("int"))
    gap = lambda d, i: F.shiftright(d, 8) - F.coalesce(F.shiftright(F.get("held", i - 1), 8), F.lit(-1)) - 1
    twice = F.raise_error(F.lit("two dies at one place")).cast("int")
    filled = lambda d, i: F.concat(zeros(F.when(gap(d, i) < 0, twice).otherwise(gap(d, i))), F.array((F.pmod(d, F.lit(256)) - 128).cast("tinyint")))
    rest = size - F.coalesce(F.shiftright(F.get("held", F.size("held") - 1), 8), F.lit(-1)) - 1
    flat = F.concat(F.flatten(F.transform("held", filled)), zeros(rest))
    rows = lambda flat: F.transform(F.array_repeat(F.lit(0), F.col("height").cast("int")), lambda _, y: F.slice(flat, y * F.col("width") + 1, F.col("width")))
    once = F.get(F.transform(F.array(flat), rows), 0)  # a variable: the optimizer would put a column's expression into every row's slice
    return grouped.withColumn("held", held).select(id_col, *carry, once.alias("wafer_map"))


def wafer_yield(cells: DataFrame, id_col: str = "wafer") -> DataFrame:
    """Dies, fails, fail fraction and yield of each wafer."""
    return cells.groupBy(id_col).agg(
        F.count("*").alias("n_die"),
        F.count_if(F.col("v") == 2).alias("n_fail"),
        F.avg((F.col("v") == 2).cast("double")).alias("fail_frac"),
        ((1.0 - F.avg((F.col("v") == 2).cast("double"))) * 100.0).alias("yield_pct"),
    )


def infer_geometry(positions: DataFrame, id_col: str = "wafer") -> DataFrame:
    """(id, pitch, radius): smallest gap of distinct die columns (1 for one column), outermost die plus half a diagonal."""
    columns = positions.groupBy(id_col, "die_x").agg(F.max("radius").alias("r"))
    gap = F.col("die_x") - F.lag("die_x").over(Window.partitionBy(id_col).orderBy("die_x"))
    return (
        columns.withColumn("gap", gap)
        .groupBy(id_col)
        .agg(F.coalesce(F.min("gap"), F.lit(1.0)).alias("pitch"), F.max("r").alias("r"))
        .select(id_col, "pitch", (F.col("r") + F.col("pitch") / 2.0 * 1.4142135623730951).alias("radius"))
    )


def effective_radius(radius: Column, edge_exclusion: Column | float = 0.0) -> Column:
    """The radius within which dies count: without the edge that is left out, never below 0."""
    return F.greatest(radius - edge_exclusion, F.lit(0.0))


def spec_yield(field: DataFrame, id_col: str = "wafer") -> DataFrame:
    """Yield of measured cells (id, z, spec_lo, spec_hi); cells without a value are no dies."""
    fail = (F.col("z") < F.col("spec_lo")) | (F.col("z") > F.col("spec_hi"))
    return field.groupBy(id_col).agg(
        F.count("z").alias("n_die"),
        F.count_if(fail).alias("n_fail"),
        F.coalesce((1.0 - F.try_divide(F.count_if(fail), F.count("z"))) * 100.0, F.lit(0.0)).alias("yield_pct"),
        F.avg("z").alias("z_mean"),
        F.stddev_pop("z").alias("z_std"),
    )


def sized(cells: DataFrame, id_col: str = "wafer", min_die: int = MIN_DIE) -> DataFrame:
    """Adds n_die and skipped (fewer than ``min_die`` dies)."""
    n = F.count("*").over(Window.partitionBy(id_col))
    return cells.withColumn("n_die", n).withColumn("skipped", F.col("n_die") < min_die)
