"""Reading, checking and writing the tables that queries work on."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.sources.dimensions import RAW_LABELS, mapped


class MissingInput(ValueError):
    """No input, or an input without what a query needs."""


class SplitLot(ValueError):
    """A lot that visited two tools in one step."""


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise MissingInput(f"missing columns: {', '.join(gone)}")
    return df


def first_existing(spark: SparkSession, candidates: Iterable[str]) -> DataFrame:
    """The first of several Parquet paths or table names that can be read (dataset discovery)."""
    tried = list(candidates)
    for name in tried:
        try:
            return spark.read.parquet(name) if "/" in name else spark.table(name)
        except Exception as e:  # Spark raises one analysis error class for every missing input
            if "PATH_NOT_FOUND" not in str(e) and "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
                raise
    raise MissingInput(f"none of these can be read: {', '.join(tried)}")


def unwrapped(label: Column) -> Column:
    """The single string of a nested (1, 1) label; null where it is empty."""
    return F.try_element_at(F.flatten(label), F.lit(1))


def labelled(raw: DataFrame, include_none: bool = False) -> DataFrame:
    """Wafers with a known label: (lot, wafer_index, wafer_map, y_true); ``none`` wafers only on request."""
    require(raw, ("lot", "wafer_index", "wafer_map", "failure_type"))
    label = unwrapped(F.col("failure_type"))
    known = mapped(RAW_LABELS | ({"none": "NONE"} if include_none else {}), label)
    return raw.withColumn("y_true", known).filter("y_true IS NOT NULL").select("lot", "wafer_index", "wafer_map", "y_true")


def label_distribution(raw: DataFrame) -> DataFrame:
    """Wafers by label, null as a group of its own."""
    return raw.groupBy(unwrapped(F.col("failure_type")).alias("ftype")).agg(F.count("*").alias("n"))


def map_shapes(raw: DataFrame) -> DataFrame:
    """Number of distinct map shapes."""
    m = F.col("wafer_map")
    return raw.agg(F.count_distinct(F.struct(F.size(m), F.size(F.try_element_at(m, F.lit(1))))).alias("n_shapes"))


PREDICTIONS = "sample_id long, lot string, y_pred string, confidence double, fail_frac double, skipped boolean"


def read_predictions(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """Predictions from a CSV file with a header, whose columns may be any of ``schema``'s in any order."""
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    return predictions(raw.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns]))


def predictions(df: DataFrame, time_col: str | None = None, tiebreak: Iterable[str] = ()) -> DataFrame:
    """Usable predictions: lot as string, skipped and null ones dropped; optional columns stay.

    With ``time_col`` rows are numbered (idx from 0) by time, null times last, equal times by ``tiebreak``, which should make
    the order total.
    """
    require(df, ("lot", "y_pred", *([time_col] if time_col else [])))
    if "skipped" in df.columns:
        df = df.filter(~F.coalesce(F.col("skipped").cast("boolean"), F.lit(False)))
    df = df.filter("y_pred IS NOT NULL").withColumn("lot", F.col("lot").cast("string"))
    if not time_col:
        return df
    from siltrace.operators.spc import numbered

    return numbered(df, (F.asc_nulls_last(time_col), *tiebreak))


def history(df: DataFrame) -> DataFrame:
    """Distinct (lot, step, tool) as strings; raises where a lot visited two tools in one step."""
    require(df, ("lot", "step", "tool"))
    own = df.select(*[F.col(c).cast("string").alias(c) for c in ("lot", "step", "tool")]).distinct()
    if found := history_duplicates(own).limit(1).collect():
        raise SplitLot(f"lot {found[0]['lot']} visited {found[0]['n_tools']} tools in step {found[0]['step']}")
    return own


def history_duplicates(own: DataFrame) -> DataFrame:
    return own.groupBy("lot", "step").agg(F.count_distinct("tool").alias("n_tools")).filter("n_tools > 1")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema (no inference pass); a byte-order mark is allowed."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8")


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result table as Parquet or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def save_all(results: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Write named results side by side: {name: path}, such as alarms and subgroups of one run, or a table for each pattern."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in results}
    for name, df in results.items():
        save(df, paths[name], kind)
    return paths
