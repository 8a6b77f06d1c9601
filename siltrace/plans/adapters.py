"""Wafer, prediction, history and score tables derived from the general test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, MID = 31, 15
# Planted pattern of each supplier number modulo 9; the last is clean.
PLANTED = ("EDGE_RING", "CENTER", "DONUT", "EDGE_LOC", "SCRATCH", "LOC", "NEAR_FULL", "RANDOM", "CLEAN")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def wafer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wafer, lot, pm, y_true, height, width, x, y, v): one wafer a supplier, noise from returned line items.

    A wafer's hits are gathered as a set of at most 961 places, so that only they are shuffled; dies are then exploded from
    constants beside them.
    """
    small = F.when(F.col("l_suppkey") % 9 == 8, 2).otherwise(10)
    hits = (
        read(spark, sf_dir, "lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 10) & (F.col("l_quantity") <= small))
        .select(
            F.col("l_suppkey").alias("wafer"),
            (((F.col("l_partkey") * 11 + F.col("l_linenumber") * 5) % SIDE) * SIDE + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % SIDE).alias("place"),
        )
        .groupBy("wafer")
        .agg(F.collect_set("place").alias("hits"))
    )
    wafers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("wafer")).join(hits, "wafer", "left")
    # Dealt before the dies are exploded: a thousandth of the rows, and what follows by wafer needs no other exchange.
    wafers = wafers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "wafer")
    axis = F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = wafers.select("wafer", "hits", F.explode(axis).alias("x")).filter(~((F.col("wafer") % 4 == 1) & (F.col("x") < 4)))
    cells = grid.select("wafer", "hits", "x", F.explode(axis).alias("y"))
    dx, dy, pm, wafer = F.col("x") - MID, F.lit(MID) - F.col("y"), F.col("pm"), F.col("wafer")
    d2 = dx * dx + dy * dy
    x, y = F.col("x"), F.col("y")
    planted = (
        F.when(pm == 0, d2 >= 152)
        .when(pm == 1, d2 <= 10)
        .when(pm == 2, d2.between(36, 86))
        .when(pm == 3, (d2 >= 144) & (F.abs(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))) - 45.0) <= 35.0))
        .when(pm == 4, F.abs(-0.5 * dx + 0.866 * dy) <= 1.0)
        .when(pm == 5, (x - 22) * (x - 22) + (y - 15) * (y - 15) <= 9)
        .when(pm == 6, (x * 7 + y * 13 + wafer * 5) % 10 < 7)
        .when(pm == 7, (x * x * 3 + y * y * 5 + x * y * 7 + wafer) % 11 == 0)
        .otherwise(False)
    )
    hit = F.coalesce(F.array_contains("hits", (y * SIDE + x).cast("long")), F.lit(False))
    names = F.array(*[F.lit(p) for p in PLANTED])
    return cells.withColumn("pm", (wafer % 9).cast("int")).filter(d2 <= MID * MID).select(
        "wafer",
        F.floor(wafer / 5).alias("lot"),
        "pm",
        F.element_at(names, pm + 1).alias("y_true"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        "x",
        "y",
        F.when(planted | hit, 2).otherwise(1).alias("v"),
    )


def spc_rows(spark: SparkSession, sf_dir: str, planted: bool = False) -> DataFrame:
    """(ts, event_id, lot, run_lot, y_pred, confidence, fail_frac) of events; ``planted`` relabels a fifth of the last rows as errors."""
    events = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    if planted:
        tail = events.agg(F.max("event_id").alias("last")).select((F.floor((F.col("last") + 1) * 8 / 10)).alias("cut"))
        events = events.crossJoin(F.broadcast(tail))
        kind = F.when((F.col("event_id") >= F.col("cut")) & (F.col("event_id") % 5 == 0), "error").otherwise(kind)
    return events.select(
        "ts",
        "event_id",
        F.col("user_id").cast("string").alias("lot"),
        F.floor(F.col("event_id") / 17).cast("string").alias("run_lot"),
        kind.alias("y_pred"),
        (1.0 - F.least(F.col("value"), F.lit(100.0)) / 100.0).alias("confidence"),
        (F.col("value") / 500.0).alias("fail_frac"),
    )


def _tool(lot, step: int):
    return ((lot * lot * (step + 2) + lot * (7 * step + 1)) % 97) % 4


def process_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lot, step, tool) with a planted cause, step 3 on tool 2, and a step 5 that mostly goes with it."""
    lots = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("lot"), F.col("l_linenumber").cast("long").alias("step")).distinct()
    lot, step = F.col("lot"), F.col("step")
    general = ((lot * lot * (step + 2) + lot * (step * 7 + 1)) % 97) % 4
    tool = F.when((step == 5) & (_tool(lot, 3) == 2) & (lot % 4 < 3), 1).otherwise(general)
    return lots.select("lot", "step", tool.cast("long").alias("tool"))


def history_hits(spark: SparkSession, sf_dir: str, planted: bool = True) -> DataFrame:
    """(lot, hit) of each line item."""
    lot = F.col("l_partkey") % 200
    hit = F.col("l_returnflag") == "R"
    if planted:
        hit = hit | ((_tool(lot, 3) == 2) & (F.col("l_quantity") > 35))
    return read(spark, sf_dir, "lineitem").select(lot.alias("lot"), hit.alias("hit"))


def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p, is_defect, y_true) from labels and the lengths of their documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    score = 1.0 / (1.0 + F.col("n_chars") / 1000.0)
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", score.alias("p"), (F.col("quality") == 0).alias("is_defect"), F.col("source").alias("y_true"))
