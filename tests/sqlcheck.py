"""Compare a query's rows with those of its SQL on the same tables."""

import glob
import math
import os

import duckdb


def connection(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in found), key=repr)


def same(spark_df, sql: str, sf: str) -> None:
    result = connection(sf).execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(spark_df.columns) == sorted(columns)
    expected = rows(columns, result.fetchall())
    assert rows(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == expected
