"""Greedy folds, medians of many keys and the exact rank test, against plain forms and at sizes that no list could hold."""

import random
import statistics
import time
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltrace.operators import commonality as C
from siltrace.operators import metrics as M
from siltrace.operators import ml as L
from siltrace.operators.ranks import quantiles_by


def greedy(sizes, folds):
    """{group: fold}, from the largest to the lightest fold."""
    loads, out = [0] * folds, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[name], loads[f] = f, loads[f] + n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_turns_are_the_greedy_rule(seed):
    rng = random.Random(seed)
    folds = rng.choice([2, 3, 4, 7])
    sizes = {i: rng.choice([1, 1, 2, 3, rng.randint(1, 40), rng.randint(1, 5000) if i < 3 else 1]) for i in range(rng.randint(1, 900))}
    counts = {}
    for n in sizes.values():
        counts[n] = counts.get(n, 0) + 1
    got = {}
    for size, first, end, own in L.fold_turns(counts, folds):
        names = sorted(i for i, n in sizes.items() if n == size)
        got |= {names[r]: own[(r - first) % len(own)] for r in range(first, end)}
    assert got == greedy(sizes, folds)


def test_group_folds_equal_the_greedy_rule(spark):
    rng = random.Random(3)
    sizes = {f"g{i}": rng.choice([1, 2, rng.randint(1, 30)]) for i in range(300)}
    df = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "lot string, k int").repartition(5)
    out = L.group_folds(df, 4).collect()
    assert len(out) == sum(sizes.values()) and {r.lot: r.fold for r in out} == greedy(sizes, 4)


def test_folds_of_a_million_groups(spark):
    n = 1_000_000
    df = spark.range(n).select(F.col("id").alias("lot")).unionByName(spark.range(n // 2).select(F.col("id").alias("lot")))
    found = L.group_folds(df, 4).groupBy("fold").agg(F.count("*").alias("n"), F.min("lot").alias("first")).collect()
    assert {r.fold: r.n for r in found} == {k: 3 * n // 8 for k in range(4)}
    assert {r.fold: r.first for r in found} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_quantiles_by_key(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f, float(v)) for k, n in (("a", 4000), ("b", 7), ("c", 1)) for f in (1, 2) for v in rng.normal(size=n).round(2)] + [("a", 1, None), ("d", 1, None), (None, 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, f int, v double").repartition(6)
    got = {(r.k, r.f, r.share): r.quantile for r in quantiles_by(df, ("k", "f"), "v", (0.0, 0.1, 0.5, 1.0)).collect()}
    for k in "abc":
        for f in (1, 2):
            own = [v for x, y, v in rows if (x, y) == (k, f) and v is not None]
            for share in (0.0, 0.1, 0.5, 1.0):
                assert got[k, f, share] == pytest.approx(np.quantile(own, share))
    assert len(got) == 24
    assert quantiles_by(df.limit(0), ("k", "f"), "v", (0.5,)).count() == 0


def test_quantiles_at_uneven_shares(spark):
    rng = np.random.default_rng(8)
    shares = sorted({0.0, 1.0, 0.5, 0.25, 1 / 3, *(0.9 + rng.random(40) / 1e6), *rng.random(60).round(2), *(k / 255 for k in range(1, 60))})
    own = {k: rng.choice(values, n) for k, values, n in (("many", rng.normal(size=900), 900), ("tied", [1.0, 2.0, 5.0], 400), ("two", [3.0, 4.0], 2), ("one", [7.0], 1))}
    df = spark.createDataFrame([(k, float(v)) for k, x in own.items() for v in x], "k string, v double").repartition(5)
    got = {(r.k, r.share): r.quantile for r in quantiles_by(df, ("k",), "v", shares).collect()}
    assert len(got) == 4 * len(shares)
    for k, x in own.items():
        assert [got[k, float(s)] for s in shares] == pytest.approx(np.quantile(x, shares))


def test_class_medians(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["A", "B", None]), rng.choice(["A", "B"]), rng.random(), float(rng.randint(0, 3)) if rng.random() < 0.8 else None) for _ in range(500)] + [("C", "A", None, None)]
    got = {r.name: r for r in M.class_medians(spark.createDataFrame(rows, "y_true string, y_pred string, p double, q double").repartition(4), ("p", "q")).collect()}
    assert set(got) == {"A", "B", "C", None}
    for name, r in got.items():
        own = [x for x in rows if x[0] == name]
        assert r.n == len(own) and r.recall == (None if name is None else sum(x[1] == name for x in own) / len(own))
        for c, at in (("p", 2), ("q", 3)):
            values = [x[at] for x in own if x[at] is not None]
            assert r[c] == (pytest.approx(statistics.median(values)) if values else None)


def test_rank_distribution_is_exact_at_any_size():
    for m, n in ((1, 1), (1, 9), (3, 4), (4, 9), (6, 7)):
        sums = [sum(p) - sum(range(m)) for p in combinations(range(m + n), m)]
        for u in range(m * n + 2):
            assert C.rank_sum_tail(u, m, n) == float(Fraction(sum(x >= u for x in sums), len(sums)))
    began = time.perf_counter()
    m, n = 8, 50_000
    # Counts of the shortest tails are numbers of partitions: 1, 1, 2, 3, 5, 7, 11 of 0, 1, 2, ... words.
    from math import comb

    for k, ways in enumerate(np.cumsum([1, 1, 2, 3, 5, 7, 11])):
        assert C.rank_sum_tail(m * n - k, m, n) == int(ways) / comb(m + n, m)
    middle = C.rank_sum_tail(m * n / 2, m, n)
    assert 0.5 < middle < 0.5001 and C.rank_sum_tail(0, m, n) == 1.0 and C.rank_sum_tail(m * n + 1, m, n) == 0.0
    # Both tails together leave the middle once.
    for u in (1000, 123_456, 390_000):
        assert C.rank_sum_tail(u, m, n) + C.rank_sum_tail(m * n - u + 1, m, n) == pytest.approx(1.0, abs=1e-12)
    C.rank_sum_tail(3 * 10**9, 8, 10**9)
    assert time.perf_counter() - began < 20


def test_commonality_is_exact_beyond_any_number_of_lots(spark):
    n = 20_000
    rates = spark.range(n + 6).select(F.col("id").cast("string").alias("lot"), (F.col("id") / (2.0 * n)).alias("rate"))
    history = spark.range(n + 6).select(F.col("id").cast("string").alias("lot"), F.lit("s").alias("step"), F.when(F.col("id") >= n, "high").otherwise("low").alias("tool"))
    from math import comb

    p = {r.tool: r.p for r in C.commonality(rates, history).collect()}
    assert p["high"] == pytest.approx(1 / comb(n + 6, 6), rel=1e-12) and p["low"] == 1.0
