"""Windows with a halo and folds over many ranges, against one pass over a list; charts of very many groups."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltrace.operators import spc as S
from siltrace.operators.scans import entry_states, own_rows, range_window, with_halo


@pytest.mark.parametrize("length", [3, 7, 4096])
def test_halo_gives_every_row_its_neighbours(spark, length):
    rows = [(k, i, float(i * i % 11)) for k, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(4)
    w = range_window("i", ["k"])
    seen = with_halo(df, "i", before=2, after=1, length=length)
    out = own_rows(seen.withColumns({"past": F.lag("v", 2).over(w), "next": F.lead("v").over(w)})).collect()
    at = {(k, i): v for k, i, v in rows}
    assert len(out) == len(rows)
    for r in out:
        assert (r.past, r["next"]) == (at.get((r.k, r.i - 2)), at.get((r.k, r.i + 1)))


@pytest.mark.parametrize("fan", [2, 5, 1000])
def test_states_pass_through_many_ranges(spark, fan):
    rng = random.Random(fan)
    states, ranges = 4, 37
    table = [([rng.randint(0, 9) for _ in range(states)], [rng.randrange(states) for _ in range(states)]) for _ in range(ranges)]
    df = spark.createDataFrame([(k, c, a) for k, (c, a) in enumerate(table)], "range long, counts array<long>, after array<long>").repartition(3)
    got, count, state = entry_states(df, states, 1, fan)
    want, n, at = {}, 0, 1
    for k, (c, a) in enumerate(table):
        want[k] = (n, at)
        n, at = n + c[at], a[at]
    assert {r["range"]: (r["count"], r.state) for r in got.collect()} == want and (count, state) == (n, at)
    none, count, state = entry_states(df.limit(0), states, 2, fan)
    assert none.count() == 0 and (count, state) == (0, 2)


def test_runs_and_groups_of_rows(spark):
    rng = random.Random(5)
    lots = []
    while len(lots) < 9000:
        lots += [rng.choice(["a", "b", None, "c"])] * rng.randint(1, 12)
    rows = spark.createDataFrame(list(enumerate(lots)), "idx long, lot string").repartition(6)
    run = [0]
    for a, b in zip(lots, lots[1:]):
        run.append(run[-1] + (a != b))
    got = {r.idx: r.run for r in S.with_runs(rows).collect()}
    assert [got[i] for i in range(len(lots))] == run
    sizes = np.bincount(run)
    runs = sorted(S.lot_runs(rows).collect(), key=lambda r: r.run)
    assert [r["size"] for r in runs] == sizes.tolist() and [r.first_idx for r in runs] == (np.cumsum(sizes) - sizes).tolist()


def test_numbered_follows_the_order_with_ties_and_nulls(spark):
    rows = [(i, (i * 7919) % 50 if i % 9 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, t long").repartition(5)
    got = {r.id: r.idx for r in S.numbered(df, (F.asc_nulls_last("t"), "id")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [got[i] for i, _ in want] == list(range(800))


def test_one_chart_of_many_groups(spark):
    # 10**6 groups of one chart: its rules and its EWMA are those of numpy over the whole series.
    n, n_base = 1_000_000, 5000
    hit = (F.xxhash64("id") % 7 + 7) % 7 + F.when(F.col("id") % 100_003 < 9, 6).otherwise(0)
    groups = spark.range(n).select(F.lit("c").alias("chart"), F.col("id").alias("gid"), F.lit(40).cast("long").alias("n"), hit.alias("count"), (F.col("id") * 40 + 39).alias("end_idx"))
    began = time.perf_counter()
    out = S.finished(S.p_chart(S.with_baseline(groups, 40 * n_base))).select("i", "z", "R1", "R2", "R3", "R4", "ewma", "above_ewma").toPandas().sort_values("i")
    assert time.perf_counter() - began < 120
    count = groups.select("gid", "count").toPandas().sort_values("gid")["count"].to_numpy()
    center = count[:n_base].sum() / (40 * n_base)
    z0 = (count / 40 - center) / (center * (1 - center) / 40) ** 0.5
    z = z0 / max(1.0, np.abs(np.diff(z0[:n_base])).mean() / 1.128)
    assert np.allclose(out["z"], z)

    def rule(length, least, beyond):
        sums = lambda x: np.convolve(x, np.ones(length), "full")[: len(x)]
        full = np.arange(n) >= length - 1
        return full & ((sums(z > beyond) >= least - 0.5) | (sums(z < -beyond) >= least - 0.5))

    assert (out["R1"].to_numpy() == (np.abs(z) > 3)).all()
    for name, args in (("R2", (3, 2, 2.0)), ("R3", (5, 4, 1.0)), ("R4", (8, 8, 0.0))):
        assert (out[name].to_numpy() == rule(*args)).all() and out[name].any()
    e, own = 0.0, np.empty(n)
    for i, v in enumerate(z.tolist()):
        own[i] = e = 0.2 * v + 0.8 * e
    assert np.allclose(out["ewma"], own, atol=1e-9)
