"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset a temporary one is set for the session, if all executors
    are threads of this process; a cluster without a shared folder is refused (ValueError)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master!r} share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_left: list[str] = []  # tables of this process that nothing has deleted


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`written` whose readers are done."""
    own = shared_dir(df.sparkSession).removeprefix("file://")
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in name:
            deleted(df.sparkSession, name)


def cleared(spark: SparkSession) -> int:
    """Delete all tables that this process has written between steps; how many there were.  For when the results of its
    queries, which read them, are written or read themselves."""
    names, _left[:] = list(_left), []
    for name in names:
        deleted(spark, name)
    return len(names)


def exists(spark: SparkSession, name: str) -> bool:
    path, store = _path(spark, name)
    return store.exists(path)


def deleted(spark: SparkSession, name: str) -> None:
    """Delete a folder, if it is there."""
    path, store = _path(spark, name)
    store.delete(path, True)
