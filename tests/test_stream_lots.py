"""Groups of lots of a stream equal those of the table, however it is cut; rows that come too late are told apart."""

import datetime as dt
import json
import random

import pytest

from siltrace.operators import spc as S
from siltrace.streaming.lots import Line, lot_groups_of_stream

SCHEMA = "ts timestamp, event_id long, lot string"
BEGIN = dt.datetime(2024, 1, 1)


def events(n=900, seed=4):
    rng = random.Random(seed)
    rows, lot = [], "a"
    for i in range(n):
        lot = rng.choice(["a", "b", "c", None]) if rng.random() < 0.15 else lot
        rows.append((BEGIN + dt.timedelta(seconds=30 * (i // 2)), i, lot))
    return rows


def batch(spark, rows, target):
    df = spark.createDataFrame([(i, r[2]) for i, r in enumerate(rows)], "idx long, lot string")
    runs = S.lot_runs(df)
    return sorted((r.run, r.first_idx, r["size"], r.lot, r.gid) for r in runs.join(S.lot_groups(runs, target), "run").collect())


def streamed(spark, tmp_path, parts, target, restart_after=()):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def start():
        found = lot_groups_of_stream(spark.readStream.schema(SCHEMA).parquet(source), target, late_ms=600_000, idle_ms=3_600_000)
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").start()

    query = start()
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
            if k in restart_after:
                query.stop()
                query = start()
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out).collect()


LAST = [(BEGIN + dt.timedelta(days=30), 10**6, "z")]


@pytest.mark.parametrize("cuts, restarts", [((250, 251, 700), (1,)), ((), ())])
def test_stream_equals_table_and_keeps_late_rows_aside(spark, tmp_path, cuts, restarts):
    rows = events()
    edges = [0, *cuts, len(rows)]
    parts = [list(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for p in parts:
        random.Random(2).shuffle(p)
    too_late = [(BEGIN + dt.timedelta(seconds=45), 5000, "late"), (BEGIN, 5001, None)]
    found = streamed(spark, tmp_path, [*parts, too_late, LAST], 40, restarts)
    assert sorted((r.run, r.first_idx, r["size"], r.lot, r.gid) for r in found if r.kind == "run") == batch(spark, rows, 40)
    assert sorted((r.ts, r.id, r.lot) for r in found if r.kind == "late") == sorted(too_late)
    assert {r.kind for r in found} == {"run", "late"}


def test_line_goes_on_from_its_memory():
    lots = [r[2] for r in events(400, 9)]
    whole = Line(25)
    want = [x for lot in lots for x in whole.add(lot)] + whole.end()
    memory, got = None, []
    for lot in lots:
        line = Line(25, json.loads(json.dumps(memory)) if memory else None)
        got += line.add(lot)
        memory = line.memory
    assert got + Line(25, memory).end() == want
    assert [r[0] for r in want] == list(range(len(want))) and sum(r[2] for r in want) == 400
    assert Line(25).end() == []
