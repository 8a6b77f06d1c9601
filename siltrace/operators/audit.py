"""Every wafer's verdict, or why it has none, and counts of both from the same pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltrace.operators.dies import MIN_DIE, die_positions
from siltrace.operators.features import global_features
from siltrace.operators.rules import classified

NO_MAP, RAGGED, UNKNOWN = "no map", "rows of unequal length", "unknown cell code"
MEASURES = ("score", "fail_frac", "r_mean", "r_std", "dir_c", "axial_c")


def map_error(map_col: str = "wafer_map") -> Column:
    """What makes a nested map unusable; null for sound ones.  Total: it raises for no map."""
    m = F.col(map_col)
    empty = m.isNull() | (F.size(m) < 1) | F.exists(m, lambda row: row.isNull())
    width = F.size(F.try_element_at(m, F.lit(1)))
    ragged = F.exists(m, lambda row: F.size(row) != width) | (width < 1)
    unknown = F.exists(m, lambda row: F.exists(row, lambda v: v.isNull() | ~v.isin(0, 1, 2)))
    return F.when(empty, NO_MAP).when(ragged, RAGGED).when(unknown, UNKNOWN)


def checked(maps: DataFrame, map_col: str = "wafer_map", min_die: int = MIN_DIE) -> DataFrame:
    """Adds error, n_die (null where there is an error) and skipped: an error, or fewer than ``min_die`` dies."""
    n_die = F.size(F.filter(F.flatten(F.col(map_col)), lambda v: v > 0)).cast("long")
    told = maps.withColumn("error", map_error(map_col)).withColumn("n_die", F.when(F.col("error").isNull(), n_die))
    return told.withColumn("skipped", F.col("error").isNotNull() | (F.col("n_die") < min_die))


def audit_counts() -> list[Column]:
    """Counts of the rows of :func:`checked`: all, kept, and skipped by reason."""
    of = lambda error: F.count_if(F.col("error") == error)
    few = F.count_if(F.col("skipped") & F.col("error").isNull())
    return [
        F.count("*").alias("wafers"), F.count_if(~F.col("skipped")).alias("kept"), few.alias("few_dies"),
        of(NO_MAP).alias("no_map"), of(RAGGED).alias("ragged"), of(UNKNOWN).alias("unknown_code"),
    ]


def classify_all(
    maps: DataFrame, *, id_col: str = "wafer", map_col: str = "wafer_map", carry: tuple[str, ...] = (), min_die: int = MIN_DIE, observation: Observation | None = None
) -> DataFrame:
    """One row per map: (id, carry..., y_pred, n_die, skipped, score, fail_frac, r_mean, r_std, dir_c, axial_c, error).

    Wafers that cannot be judged are kept: skipped, with null verdict and measures, and with the error if the map is unusable (few dies
    are none).  observation: receives :func:`audit_counts` when the result is computed, without a further scan.  Ids are
    unique; each map lies in one row, so that a wafer's dies are exploded and aggregated in one pass.
    """
    told = checked(maps.select(id_col, map_col, *carry), map_col, min_die)
    if observation is not None:
        told = told.observe(observation, *audit_counts())
    m = F.when(~F.col("skipped"), F.col(map_col))
    own = [id_col, *carry, "error", "n_die", "skipped"]
    rows = told.select(*own, F.size(m).alias("height"), F.size(F.try_element_at(m, F.lit(1))).alias("width"), F.posexplode_outer(m).alias("y", "row"))
    cells = rows.select(*own, "height", "width", "y", F.posexplode_outer("row").alias("x", "v")).filter("skipped OR v > 0")
    measured = global_features(die_positions(cells.withColumnRenamed("n_die", "_dies")), id_col, carry=(*carry, "error", "_dies", "skipped"))
    judged = classified(measured.drop("n_die").withColumnRenamed("_dies", "n_die"))
    kept = lambda c: F.when(~F.col("skipped"), F.col(c)).alias(c)
    return judged.select(id_col, *carry, kept("y_pred"), "n_die", "skipped", *[kept(c) for c in MEASURES], "error")
