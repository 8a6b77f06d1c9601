"""Connected components of a table of links, by hooking and pointer jumping on Spark tables.

Every id hooks onto its smallest neighbour if that is smaller than itself, which makes a forest; pointers jump until each id
points to its root; links are moved to the roots, and the next round hooks these, until no link is left.  At least half of the
linked ids are gone after a round.  Minima are partial aggregates, and joins have plain exchanges of written tables on both
sides, so that the links of a hub are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.storage import dropped, written


def rooted(parents: DataFrame) -> DataFrame:
    """(id, root) from a forest (id, parent), by jumping: after k rounds pointers span 2**k levels."""
    table = written(parents.select("id", F.col("parent").alias("root"), F.lit(True).alias("moved")), "pointers")
    while not table.filter("moved").isEmpty():
        up = table.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = table.select("id", "root").hint("merge").join(up, "root", "left")
        after = written(jumped.select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        dropped(table)
        table = after
    return table.select("id", "root")


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after the components of ``labels`` were joined as in ``more``, whose ids are components or new ids."""
    to = more.select(F.col("id").alias("component"), F.col("component").alias("to"))
    moved = labels.hint("merge").join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return written(moved.unionByName(more.join(labels.select("id"), "id", "left_anti")), "components")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable over links."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        # The larger end of a link sees a smaller neighbour; the smaller end need not look.
        roots = rooted(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("parent")))
        tops = roots.select(F.col("root").alias("id")).distinct().withColumn("component", F.col("id"))
        found = written(roots.withColumnRenamed("root", "component").unionByName(tops), "roots")
        labels = found if labels is None else relabelled(labels, found)
        of = lambda column, to: roots.select(F.col("id").alias(column), F.col("root").alias(to))
        both = edges.hint("merge").join(of("u", "ru"), "u", "left").hint("merge").join(of("v", "rv"), "v", "left")
        ends = both.select(F.coalesce("ru", "u").alias("x"), F.coalesce("rv", "v").alias("y")).filter("x <> y")
        after = written(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
        dropped(edges)
        edges = after
    return labels if labels is not None else edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
