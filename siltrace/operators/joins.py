"""Lookups that no frequent key can bring down."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each value of ``keys``.

    Keys that more than one in ``hot_keys`` of the rows bear are at most ``hot_keys`` many: their rows of the table are sent
    to all tasks, and so no task meets all rows of such a key.  The others meet in a shuffle.  Rows with a null key find nothing,
    and are not shuffled.  ``rows`` is read several times.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed = rows.filter(known)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in keys]
    columns = [*rows.columns, *[c for c in table.columns if c not in keys]]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") * hot_keys > keyed.count()).select(*keys).collect()  # at most hot_keys rows
    blank = rows.filter(~known).select("*", *nothing)
    if not hot:
        return keyed.hint("merge").join(table, list(keys), "left").select(*columns).unionByName(blank)
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    frequent = F.broadcast(hot.join(table, list(keys), "left"))
    by_broadcast = keyed.join(frequent, list(keys)).select(*columns)
    rest = keyed.join(hot, list(keys), "left_anti").hint("merge").join(table, list(keys), "left").select(*columns)
    return by_broadcast.unionByName(rest).unionByName(blank)
