"""Ordered analytics over ranges of an order: windows with a halo, and folds whose state passes from range to range.

A scan of n rows is cut into ranges.  Windows that look a few rows back (or ahead) get these rows copied into the range that needs
them.  A fold that depends on all rows before is first composed range by range, as a table from the state it is entered with to the
state it is left with; compositions of neighbours are composed again until few are left, and the states are then handed down.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltrace.sources.stored import written

RANGE = 4096  # rows of one range
FAN = 1024  # compositions that one task composes


def with_halo(df: DataFrame, place: str, before: int = 0, after: int = 0, length: int = RANGE) -> DataFrame:
    """Rows in ranges of ``length`` places, each with copies of the last ``before`` rows of the range before it and the first ``after`` of
    the next one: adds _range and _own, which is false for copies.

    ``place`` counts from 0 without gaps, within each key if there are several.  ``length`` is at least ``before`` and ``after``."""
    own, at = F.floor(F.col(place) / length), F.col(place) % length
    copies = [F.struct(own.alias("_range"), F.lit(True).alias("_own"))]
    if before:
        copies.append(F.when(at >= length - before, F.struct((own + 1).alias("_range"), F.lit(False).alias("_own"))))
    if after:
        copies.append(F.when((at < after) & (own > 0), F.struct((own - 1).alias("_range"), F.lit(False).alias("_own"))))
    return df.select("*", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())).alias("_in")).select("*", "_in.*").drop("_in")


def range_window(place: str, by: Sequence[str] = ()):
    """The ordered window of each range of :func:`with_halo`."""
    return Window.partitionBy(*by, "_range").orderBy(place)


def own_rows(df: DataFrame) -> DataFrame:
    """Without the copies."""
    return df.filter("_own").drop("_range", "_own")


def entry_states(outcomes: DataFrame, states: int, start: int = 0, fan: int = FAN) -> tuple[DataFrame, int, int]:
    """((range, count, state) with which each range is entered, count and state at the end).

    outcomes: (range, counts, after), numbered from 0 without gaps: for each of ``states`` states in which the range may be entered, what it
    adds to the count, and the state it is left in.  No task composes more than ``fan`` ranges.
    """

    def composed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        at, count = np.arange(states), np.zeros(states, np.int64)
        for counts, after in _tables(table, states):
            count, at = count + counts[at], after[at]
        return pa.table({"range": [key[0].as_py()], "counts": pa.array([count.tolist()], pa.list_(pa.int64())), "after": pa.array([at.tolist()], pa.list_(pa.int64()))})

    def entered(key: tuple[pa.Scalar, ...], table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("range")
        count, at = above["count"][0].as_py(), above["state"][0].as_py()
        rows = []
        for name, (counts, after) in zip(table["range"].to_pylist(), _tables(table, states), strict=True):
            rows.append((name, count, at))
            count, at = count + int(counts[at]), int(after[at])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("range", "count", "state"), zip(*rows, strict=True), strict=True)})

    parent = F.floor(F.col("range") / fan)
    levels = [outcomes]
    n = outcomes.count()
    while n > 1:
        up = levels[-1].withColumn("parent", parent).groupBy("parent").applyInArrow(composed, "range long, counts array<long>, after array<long>")
        levels.append(written(up, "composed"))
        n = -(-n // fan)
    whole = levels[-1].first()
    spark = outcomes.sparkSession
    if whole is None:
        return spark.createDataFrame([], "range long, count long, state long"), 0, start
    states_in = spark.createDataFrame([(0, 0, start)], "range long, count long, state long")
    for level in levels[-2::-1]:
        cogroup = level.withColumn("parent", parent).groupBy("parent").cogroup(states_in.withColumnRenamed("range", "parent").groupBy("parent"))
        states_in = written(cogroup.applyInArrow(entered, "range long, count long, state long"), "entered")
    return states_in, int(whole["counts"][start]), int(whole["after"][start])


def _tables(table: pa.Table, states: int):
    counts, after = (table[c].combine_chunks().flatten().to_numpy().reshape(-1, states) for c in ("counts", "after"))
    return zip(counts, after, strict=True)


