"""Wafer features: 6 global, 11 structural, 3 of position, 8 robust to noise.

Dies are dealt by wafer once.  The box of a wafer comes from a window over that partitioning, and one aggregate gives all
features of dies, the columns that are carried along, and the failing dies as an array.  These arrays are labelled, and the
components give the other features through one aggregate by component and one by wafer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltrace.functions.columns import concentration, norm2, wrapped
from siltrace.operators.components import label_arrays
from siltrace.operators.dies import die_positions
from siltrace.sources.stored import deleted, dropped, exists, written

GLOBAL = ("fail_frac", "r_mean", "r_med", "r_std", "dir_c", "axial_c")
PROFILE = tuple(f"prof{b}" for b in range(5))
STRUCTURAL = ("n_comp", "largest_frac", "comp_size_mean", "elongation", "outer_cover", "outer_rate", *PROFILE)
POSITION = ("big_r", "big_span", "big_r_min")
ROBUST = ("isolated_frac", "n_comp_sig", "sig_frac", "fail_nb_mean", "big_extent", "big_len", "big_edge_touch", "second_frac")
FEATURES = (*GLOBAL, *STRUCTURAL, *POSITION, *ROBUST)
CLEAN_FRAC, OUTER, ANGLE_BINS, RADIAL_BINS, SIGNIFICANT = 0.02, 0.75, 24, 5, 3


def upward_angle(uy: Column, ux: Column) -> Column:
    """Angle of (ux, -uy) in [-pi, pi); the left horizontal axis is -pi."""
    return F.when((uy == 0) & (ux < 0), F.lit(-pi)).otherwise(F.atan2(-uy, ux))


def settled_angle(y: Column, x: Column) -> Column:
    """atan2 of values that may be rounding noise about 0: such count as 0."""
    return F.atan2(F.round(y, 12) + 0.0, F.round(x, 12) + 0.0)


def with_box(cells: DataFrame, id_col: str = "wafer") -> DataFrame:
    """Adds the box geometry: ux, uy (unit coordinates about the box centre), rn, ang, half widths hx, hy, and edge dies."""
    w = Window.partitionBy(id_col)
    x, y = F.col("x"), F.col("y")
    half = lambda c: F.greatest((F.max(c).over(w) - F.min(c).over(w)) / 2.0, F.lit(1e-9))
    mid = lambda c: (F.max(c).over(w) + F.min(c).over(w)) / 2.0
    row, column = Window.partitionBy(id_col, "y").orderBy("x"), Window.partitionBy(id_col, "x").orderBy("y")
    next_to = lambda c, by: (c - F.lag(c).over(by) == 1) & (F.lead(c).over(by) - c == 1)
    return (
        cells.withColumns({"hx": half("x"), "hy": half("y"), "mx": mid("x"), "my": mid("y")})
        .withColumn("edge", ~F.coalesce(next_to(x, row) & next_to(y, column), F.lit(False)))
        .withColumns({"ux": (x - F.col("mx")) / F.col("hx"), "uy": (y - F.col("my")) / F.col("hy")})
        .withColumns({"rn": norm2(F.col("ux"), F.col("uy")), "ang": upward_angle(F.col("uy"), F.col("ux"))})
    )


def _global_parts() -> list[Column]:
    """fail_frac and the statistics of failing dies, in die_positions' columns."""
    fail = F.col("v") == 2
    r, a = F.when(fail, F.col("radius")), F.radians("angle_deg")
    full = F.max("radius")
    scale = F.when(full > 0, full).otherwise(1.0)
    return [
        F.count("*").alias("n_die"),
        F.count_if(fail).alias("n_fail"),
        F.avg(fail.cast("double")).alias("fail_frac"),
        (F.avg(r) / scale).alias("r_mean"),
        (F.median(r) / scale).alias("r_med"),
        (F.stddev_pop(r) / scale).alias("r_std"),
        concentration(a, 1, fail).alias("dir_c"),
        concentration(a, 2, fail).alias("axial_c"),
    ]


def _zeroed(zeroing: bool = True) -> dict[str, Column]:
    held = (F.col("fail_frac") > CLEAN_FRAC) if zeroing else F.lit(True)
    return {c: F.when(held, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in GLOBAL[1:]}


def _carried(carry: tuple[str, ...]) -> list[Column]:
    return [F.first(c).alias(c) for c in carry]


def global_features(positions: DataFrame, id_col: str = "wafer", zeroing: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """fail_frac and five statistics of failing dies; these are 0 for wafers of at most 2 % fails unless zeroing is off.

    carry: columns that are constant within a wafer and are returned too."""
    return positions.groupBy(id_col).agg(*_global_parts(), *_carried(carry)).withColumns(_zeroed(zeroing))


def _structural_parts() -> list[Column]:
    """Coverage of the outer ring by angle and the radial profile, in with_box's columns."""
    fail = F.col("v") == 2
    outer = F.round("rn", 9) >= OUTER
    turn = F.floor(F.round((F.col("ang") + pi) / (2 * pi) * ANGLE_BINS, 9)).cast("int")
    bin_ = F.least(F.greatest(turn, F.lit(0)), F.lit(ANGLE_BINS - 1))
    rn = F.round("rn", 9)
    rate = F.avg(fail.cast("double"))

    def profile(b: int) -> Column:
        lo, hi = b / RADIAL_BINS, (b + 1) / RADIAL_BINS
        inside = (rn >= lo) & ((rn < hi) if b < RADIAL_BINS - 1 else (rn <= hi))
        own = F.avg(F.when(inside, fail.cast("double")))
        return F.when((F.count_if(inside) >= 5) & (rate > 0), own / rate).otherwise(1.0).alias(f"prof{b}")

    # Angle bins as the bits of one number.
    bits = lambda where: F.bit_count(F.coalesce(F.bit_or(F.when(where, F.call_function("shiftleft", F.lit(1).cast("long"), bin_))), F.lit(0).cast("long")))
    return [
        F.coalesce(F.try_divide(bits(outer & fail).cast("double"), bits(outer).cast("double")), F.lit(0.0)).alias("outer_cover"),
        F.coalesce(F.avg(F.when(outer, fail.cast("double"))), F.lit(0.0)).alias("outer_rate"),
        *[profile(b) for b in range(RADIAL_BINS)],
    ]


def structural_die_features(boxed: DataFrame, id_col: str = "wafer") -> DataFrame:
    """Coverage of the outer ring by angle and the radial profile."""
    return boxed.groupBy(id_col).agg(*_structural_parts())


_FAIL = ("y", "x", "ux", "uy", "hx", "hy", "rn", "ang", "edge")


def _fails() -> Column:
    """The failing dies of a wafer as an array."""
    own = [F.col(c).cast("long").alias(c) if c in ("x", "y") else F.col(c) for c in _FAIL]
    return F.collect_list(F.when(F.col("v") == 2, F.struct(*own))).alias("fails")


def component_table(boxed: DataFrame, id_col: str = "wafer") -> DataFrame:
    """One row for each component of failing dies, with its size and shape."""
    return _component_rows(label_arrays(boxed.groupBy(id_col).agg(_fails()), id_col), id_col)


def _component_rows(labelled: DataFrame, id_col: str) -> DataFrame:
    """Components from wafers with their failing dies and their labels (arrays fails, comp, neighbours)."""
    zipped = F.arrays_zip("fails", "comp", "neighbours")
    cells = labelled.select(id_col, F.explode(zipped).alias("c")).select(id_col, "c.fails.*", "c.comp", "c.neighbours")
    own = cells.groupBy(id_col, "comp").agg(
        F.count("*").alias("size"),
        F.sum("neighbours").alias("neighbours"),
        F.var_samp("x").alias("vx"),
        F.var_samp("y").alias("vy"),
        F.covar_samp("x", "y").alias("vxy"),
        F.var_samp("ux").alias("wx"),
        F.var_samp("uy").alias("wy"),
        F.covar_samp("ux", "uy").alias("wxy"),
        F.avg("ux").alias("mux"),
        F.avg("uy").alias("muy"),
        F.min("rn").alias("rn_min"),
        settled_angle(F.avg(F.sin("ang")), F.avg(F.cos("ang"))).alias("mean_ang"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
        F.first("hx").alias("hx"),
        F.first("hy").alias("hy"),
        F.avg(F.col("edge").cast("double")).alias("edge_touch"),
        F.collect_list(F.struct("ux", "uy", "ang")).alias("cells"),
    )
    large = lambda a, b, c: (a + b) / 2 + F.sqrt((a - b) * (a - b) / 4 + c * c)
    small = lambda a, b, c: (a + b) / 2 - F.sqrt((a - b) * (a - b) / 4 + c * c)
    floor = lambda c: F.greatest(c, F.lit(1e-9))
    v = [F.col(c) for c in ("vx", "vy", "vxy")]
    theta = settled_angle(2 * F.col("wxy"), F.col("wx") - F.col("wy")) / 2
    dev = F.transform("cells", lambda s: wrapped(s["ang"] - F.col("mean_ang")))
    along = F.transform("cells", lambda s: s["ux"] * F.cos("theta") + s["uy"] * F.sin("theta"))
    spread = lambda a: F.array_max(a) - F.array_min(a)
    return own.withColumn("theta", theta).select(
        id_col,
        "comp",
        "size",
        "neighbours",
        F.when(F.col("size") >= 3, F.sqrt(floor(large(*v)) / floor(small(*v)))).otherwise(1.0).alias("elongation"),
        norm2(F.col("mux"), F.col("muy")).alias("big_r"),
        F.when(F.col("size") > 1, F.degrees(spread(dev))).otherwise(0.0).alias("big_span"),
        F.col("rn_min").alias("big_r_min"),
        (F.col("size") / (F.col("w") * F.col("h"))).alias("big_extent"),
        F.when(F.col("size") >= 3, spread(along)).otherwise(F.greatest(F.col("h") / F.col("hy"), F.col("w") / F.col("hx"))).alias("big_len"),
        F.col("edge_touch").alias("big_edge_touch"),
    )


def component_features(components: DataFrame, id_col: str = "wafer") -> DataFrame:
    """Features of each wafer from its components.  Of equal largest components, shape and position take the first in raster
    order, the robust features the last."""
    first, last = F.struct("size", -F.col("comp")), F.struct("size", "comp")
    sizes = F.sort_array(F.collect_list("size"), asc=False)
    large = F.col("size") >= SIGNIFICANT
    total = F.sum("size")
    of = lambda c, by: F.max_by(c, by).alias(c)
    return components.groupBy(id_col).agg(
        F.count("*").cast("double").alias("n_comp"),
        (F.max("size") / total).alias("largest_frac"),
        F.avg("size").alias("comp_size_mean"),
        *[of(c, first) for c in ("elongation", "big_r", "big_span", "big_r_min")],
        (F.count_if(F.col("size") == 1) / total).alias("isolated_frac"),
        F.count_if(large).cast("double").alias("n_comp_sig"),
        (F.sum(F.when(large, F.col("size")).otherwise(0)) / total).alias("sig_frac"),
        (F.sum("neighbours") / total).alias("fail_nb_mean"),
        *[of(c, last) for c in ("big_extent", "big_len", "big_edge_touch")],
        F.coalesce(F.get(sizes, 1) / F.get(sizes, 0), F.lit(0.0)).alias("second_frac"),
    )


FEATURE_VERSION = "28-1"  # of the set below; a kept table of another version is not read
FEATURE_BUCKETS = 64
_WITHOUT_FAILS = {"elongation": 1.0}


def wafer_features(cells: DataFrame, id_col: str = "wafer", carry: tuple[str, ...] = ()) -> DataFrame:
    """All 28 features and n_die of every wafer, with the columns named in ``carry`` (constant within a wafer)."""
    boxed = with_box(die_positions(cells), id_col)
    one = boxed.groupBy(id_col).agg(*_global_parts(), *_structural_parts(), *_carried(carry), _fails()).withColumns(_zeroed())
    labelled = written(label_arrays(one, id_col), "labelled-wafers")
    components = component_features(_component_rows(labelled.select(id_col, "fails", "comp", "neighbours"), id_col), id_col)
    parts = labelled.drop("fails", "comp", "neighbours").join(components, id_col, "left")
    parts = parts.withColumns({c: F.coalesce(c, F.lit(_WITHOUT_FAILS.get(c, 0.0))) for c in FEATURES})
    return parts.select(id_col, *carry, "n_die", *FEATURES)


@dataclass(frozen=True)
class Refreshed:
    """A kept feature table, and how many wafers were computed and removed to bring it up to date."""

    table: DataFrame
    computed: int
    removed: int


def map_contents(cells: DataFrame, id_col: str = "wafer", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, content): a text that changes when a wafer's dies or carried columns do, whatever the order of its rows."""
    cell = F.xxhash64("height", "width", "x", "y", "v")
    parts = [F.count("*"), F.bit_xor(cell), F.bit_xor(F.xxhash64(F.lit("again"), "x", "y", "v")), *[F.xxhash64(F.first(c)) for c in carry]]
    return cells.groupBy(id_col).agg(F.concat_ws(":", *[p.cast("string") for p in parts]).alias("content"))


def refreshed_features(cells: DataFrame, folder: str, id_col: str = "wafer", carry: tuple[str, ...] = (), buckets: int = FEATURE_BUCKETS) -> Refreshed:
    """:func:`wafer_features` of the cells, kept in ``folder`` by version of the feature set and brought up to date.

    Wafers whose content is that of the kept row are not computed again; new and changed ones are, and those without cells are
    removed.  The table lies in ``buckets`` partitions by a hash of the id, of which only those with changes are written anew.  A refresh
    that breaks off leaves rows of both states, each with its content, and the next one goes on from there.
    """
    spark, target = cells.sparkSession, f"{folder.rstrip('/')}/features-{FEATURE_VERSION}"
    found = written(map_contents(cells, id_col, carry), "map-contents")
    bucket = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("bucket")
    kept = spark.read.parquet(target) if exists(spark, target) else None
    key = [id_col, "content"]
    stale = written((found if kept is None else found.join(kept.select(*key), key, "left_anti")).select(*key, bucket), "stale-wafers")
    gone = None if kept is None else written(kept.join(found.select(id_col), id_col, "left_anti").select(id_col, "bucket"), "gone-wafers")
    computed, removed = stale.count(), 0 if gone is None else gone.count()
    if computed:
        fresh = wafer_features(cells.join(stale.select(id_col), id_col, "left_semi"), id_col, carry).join(stale, id_col)
    if computed or removed:
        touched = [r["bucket"] for r in (stale.select("bucket") if gone is None else stale.select("bucket").union(gone.select("bucket"))).distinct().collect()]
        parts = [fresh] if computed else []
        if kept is not None:
            parts.append(kept.filter(F.col("bucket").isin(touched)).join(found, key, "left_semi"))
        after = written(reduce(lambda a, b: a.unionByName(b), parts), "fresh-features")
        if kept is not None:  # an overwritten partition without rows would stay
            left = {r["bucket"] for r in after.select("bucket").distinct().collect()}
            for b in set(touched) - left:
                deleted(spark, f"{target}/bucket={b}")
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)
        dropped(after)
    for table in (found, stale, gone):
        if table is not None:
            dropped(table)
    schema = kept.schema if kept is not None else None
    table = (spark.read.schema(schema) if schema else spark.read).parquet(target) if exists(spark, target) else wafer_features(cells.limit(0), id_col, carry)
    return Refreshed(table.drop("content", "bucket"), computed, removed)


def feature_table(cells: DataFrame, folder: str, id_col: str = "wafer", carry: tuple[str, ...] = ()) -> DataFrame:
    """The table of :func:`refreshed_features`."""
    return refreshed_features(cells, folder, id_col, carry).table
