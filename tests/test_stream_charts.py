"""Alarms of a stream equal those of the batch, however it is cut, in whatever order it comes, and after restarts."""

import datetime as dt
import random

import pytest

from siltrace.operators import spc as S
from siltrace.streaming.charts import MEAN, Chart, chart_alarms

CLASSES = ("A", "B", "C")
N_BASE = 1000


def predictions(n=2600, seed=2):
    rng = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        drift = 0.15 if i > 1700 else 0.0
        x = rng.random()
        y = "A" if x < 0.2 + drift else "B" if x < 0.3 + 2 * drift else "Z"  # C never comes: no chart
        rows.append((begin + dt.timedelta(seconds=20 * (i // 2)), i, y, 0.5 if rng.random() < 0.1 + drift else 0.9, 0.3 + 0.1 * rng.random() + drift if i % 7 else None))
    return rows


SCHEMA = "ts timestamp, event_id long, y_pred string, confidence double, fail_frac double"


def batch_alarms(spark, rows):
    df = spark.createDataFrame([(i, "lot", r[2], r[3], r[4]) for i, r in enumerate(rows)], "idx long, lot string, y_pred string, confidence double, fail_frac double")
    return rounded(S.alarms(S.build_charts(df, CLASSES, 25, N_BASE)).collect())


def rounded(found):
    names = ("chart", "subgroup", "end_idx", "phase", "rule", "value", "z", "direction")
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in found)


def streamed(spark, tmp_path, parts, restart_after=(), **more):
    """Alarms of the rows of ``parts``, a micro-batch each; the query is stopped and started anew after some."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def start():
        found = chart_alarms(spark.readStream.schema(SCHEMA).parquet(source), CLASSES, n_base_rows=N_BASE, late="1 hour", idle=7_200_000, **more)
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
    return rounded(spark.read.parquet(out).collect())


# A row long after the others moves the watermark past them; it has no place in any chart's baseline.
LAST = [(dt.datetime(2024, 3, 1), 10**6, "Z", 0.9, None)]


@pytest.mark.parametrize("cuts, restarts", [((900, 901, 1850), (1,)), ((), ()), ((300, 2000), (0, 1))])
def test_stream_equals_batch(spark, tmp_path, cuts, restarts):
    rows = predictions()
    want = batch_alarms(spark, rows)
    assert {r[0] for r in want} == {"A", "B", "LOW_CONFIDENCE", MEAN} and {r[3] for r in want} == {"baseline", "monitor"}
    edges = [0, *cuts, len(rows)]
    parts = [list(rows[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for p in parts:
        random.Random(1).shuffle(p)  # within the watermark any order will do
    assert streamed(spark, tmp_path, [*parts, LAST], restarts) == want


def test_chart_goes_on_from_its_memory(spark):
    import json

    rows = predictions(2000, 5)
    hits = [float(r[2] == "A") for r in rows]
    whole = Chart(False, 25, N_BASE, True)
    want = whole.add(hits) + whole.end()
    memory, got = None, []
    for k in range(0, len(hits), 37):
        part = Chart(False, 25, N_BASE, True, json.loads(json.dumps(memory)) if memory else None)
        got += part.add(hits[k : k + 37])
        memory = part.memory
    assert got + Chart(False, 25, N_BASE, True, memory).end() == want and want
    assert len(memory["groups"]) == len(memory["blocks"]) == 0 and len(memory["last"]) == 8  # state does not grow
    assert not Chart(False, 25, 100, True).add([0.0] * 500)  # no hit, no chart
    assert not Chart(False, 25, 100, True).add([1.0] * 500)  # hits only
