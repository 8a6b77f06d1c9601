"""Hand-made cases: sequences with known answers, planted patterns, and defined edge cases."""

import time

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from siltrace.operators import commonality as C
from siltrace.operators import dies as D
from siltrace.operators import features as W
from siltrace.operators import metrics as M
from siltrace.operators import ml as L
from siltrace.operators import rules as R
from siltrace.operators import spc as S
from siltrace.operators.ranks import cumulated
from siltrace.sources import generators as G
from siltrace.sources import tables as T
from siltrace.sources.dimensions import CLASSES, expected_patterns
from siltrace.streaming.monitor import beyond_limits, window_shares


def points(spark, *series):
    rows = [(f"c{k}", i, float(v)) for k, z in enumerate(series) for i, v in enumerate(z)]
    return spark.createDataFrame(rows, "chart string, i int, z double")


def by_hand(z):
    """The four rules read off each full window of one side."""

    def run(length, least, beyond):
        full = [(i, z[i - length + 1 : i + 1]) for i in range(length - 1, len(z))]
        return {i for i, w in full if any(sum(side * v > beyond for v in w) >= least for side in (1, -1))}

    return {"R1": {i for i, v in enumerate(z) if abs(v) > 3}, "R2": run(3, 2, 2), "R3": run(5, 4, 1), "R4": run(8, 8, 0)}


def test_western_electric_equals_windows_read_by_hand(spark):
    rng = np.random.default_rng(17)
    series = [rng.normal(shift, spread, n).round(2) for shift, spread, n in ((0, 1.4, 300), (0.8, 0.9, 120), (-1.1, 1.2, 90), (0, 1, 7), (2.2, 0.1, 2))]
    rows = S.western_electric(points(spark, *series)).collect()
    for k, z in enumerate(series):
        want = by_hand(z.tolist())
        assert {rule: {r.i for r in rows if r.chart == f"c{k}" and r[rule]} for rule in want} == want
        assert k > 2 or all(want.values())


def test_ewma_equals_its_recurrence_over_many_blocks(spark):
    rng = np.random.default_rng(23)
    for lam in (0.2, 0.05, 1.0):
        series = [rng.normal(0.3, 1, n) for n in (700, 62, 63, 1)]
        rows = {(r.chart, r.i): r for r in S.ewma(points(spark, *series), lam=lam).collect()}
        assert len(rows) == 826
        for k, z in enumerate(series):
            e, before = 0.0, 0.0
            for i, v in enumerate(z):
                e = lam * v + (1 - lam) * e
                r = rows[f"c{k}", i]
                assert r.ewma == pytest.approx(e, abs=1e-9) and before <= r.ewma_limit <= 2.7 * (lam / (2 - lam)) ** 0.5 + 1e-12
                before = r.ewma_limit


def merged_by_hand(sizes, target):
    out, g, held = [], 0, 0
    for n in sizes:
        out.append(g)
        held += n
        if held >= target:
            g, held = g + 1, 0
    return [-1 if x == g and 2 * held < target else x for x in out]


def test_runs_merge_in_order_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(31)
    sizes = rng.integers(1, 30, 90).tolist()
    lots = [f"l{i % 7}" for i, n in enumerate(sizes) for _ in range(n)]
    rows = spark.createDataFrame(list(enumerate(lots)), "idx long, lot string").repartition(5)
    runs = S.lot_runs(rows).persist()
    assert [r["size"] for r in sorted(runs.collect(), key=lambda r: r.run)] == sizes
    monkeypatch.setattr(S, "RUN_BLOCK", 8)
    for target in (1, 40, 77, 10_000):
        got = [r.gid for r in sorted(S.lot_groups(runs, target).collect(), key=lambda r: r.run)]
        assert got == merged_by_hand(sizes, target)


def test_fixed_groups_drop_a_tail_below_half_a_group(spark):
    for total, tail in ((95, -1), (96, 9), (100, 9), (90, 8)):
        rows = S.fixed_groups(spark.range(total).withColumnRenamed("id", "idx"), F.lit(10), F.lit(total)).collect()
        gid = {r.idx: r.gid for r in rows}
        assert gid[total - 1] == (9 if total == 95 else tail) and all(gid[i] == i // 10 for i in range(90))
    rows = S.fixed_groups(spark.range(94).withColumnRenamed("id", "idx"), F.lit(10), F.lit(94)).collect()
    assert {r.gid for r in rows if r.idx >= 90} == {-1}


def groups(spark, rows):
    return spark.createDataFrame([("c", i, n, c, e, nb) for i, (n, c, e, nb) in enumerate(rows)], "chart string, i int, n long, count long, end_idx long, n_base long")


def test_p_chart_limits_are_those_of_its_baseline(spark):
    counts = [7, 4, 6, 5, 8, 6, 30, 5, 0]
    rows = [(40, c, 40 * (i + 1), 6) for i, c in enumerate(counts)]
    out = sorted(S.finished(S.p_chart(groups(spark, rows), laney=False)).collect(), key=lambda r: r.i)
    center = sum(counts[:6]) / 240
    sigma = (center * (1 - center) / 40) ** 0.5
    for r, c in zip(out, counts, strict=True):
        assert r.center == pytest.approx(center) and r.z == pytest.approx((c / 40 - center) / sigma)
        assert r.R1 == (abs(c / 40 - center) > 3 * sigma)
    assert [r.i for r in out if r.R1] == [6]


def test_laney_factor_is_the_mean_moving_range(spark):
    rng = np.random.default_rng(41)
    counts = [int(c) for c in rng.integers(10, 90, 40)]
    rows = [(150, c, 150 * (i + 1), 25) for i, c in enumerate(counts)]
    center = sum(counts[:25]) / (25 * 150)
    z = (np.array(counts[:25]) / 150 - center) / (center * (1 - center) / 150) ** 0.5
    factor = max(1.0, float(np.abs(np.diff(z)).mean()) / 1.128)
    wide, plain = S.p_chart(groups(spark, rows)).first(), S.p_chart(groups(spark, rows), laney=False).first()
    assert factor > 2 and wide.sigma_z == pytest.approx(factor) and plain.sigma_z == 1.0
    assert wide.sigma == pytest.approx(plain.sigma * factor)


def test_bh_equals_the_smallest_scaled_p_from_its_place_on(spark):
    rng = np.random.default_rng(53)
    p = [round(float(x), 3) for x in rng.random(25) ** 3] + [None, None]
    up = sorted(x for x in p if x is not None)
    want = {x: min(1.0, min(up[k] * len(up) / (k + 1) for k in range(len(up)) if up[k] >= x)) for x in up}
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(p)], "step int, tool int, p double")
    for r in C.bh_adjust(df).collect():
        assert (r.p_adj is None) if r.p is None else r.p_adj == pytest.approx(want[r.p])


def test_exact_rank_test_counts_all_orders(spark):
    from itertools import combinations

    for m, n in ((5, 5), (5, 7), (6, 6)):
        u = [sum(places) - sum(range(m)) for places in combinations(range(m + n), m)]
        for k in range(0, m * n + 1, 3):
            assert C.rank_sum_tail(k, m, n) == pytest.approx(sum(x >= k for x in u) / len(u))
            assert C.rank_sum_tail(k, n, m) == pytest.approx(C.rank_sum_tail(k, m, n))
    rates = spark.createDataFrame([(str(i), i / 100) for i in range(12)], "lot string, rate double")
    history = spark.createDataFrame([(str(i), "s", "high" if i >= 5 else "low") for i in range(12)], "lot string, step string, tool string")
    p = {r.tool: r.p for r in C.commonality(rates, history).collect()}
    assert p["high"] == pytest.approx(1 / 792) and p["low"] == pytest.approx(1.0)


@pytest.fixture(scope="module")
def demo(spark):
    predictions, history = G.demo_lots(spark, lots=480, seed=1)
    rates = C.lot_rates(predictions, "EDGE_RING").persist()
    return rates, T.history(history).persist()


def test_planted_cause_is_first_and_its_companion_confounded(spark, demo):
    rates, history = demo
    table = C.verdicts(C.confounding(rates, history, C.commonality(rates, history))).collect()
    by = {(r.step, r.tool): r for r in table}
    assert by["ETCH", "ETCH-03"].place == 1 and by["ETCH", "ETCH-03"].p_adj < 1e-4
    companion = by["DEP", "DEP-02"]
    assert companion.p_adj < 0.05 and companion.confounded_with == "ETCH/ETCH-03" and companion.verdict == "confounded"


def test_more_wafers_of_the_same_lots_leave_p_unchanged(spark):
    predictions, history = G.demo_lots(spark, lots=60, seed=1)
    one = C.commonality(C.lot_rates(predictions, "EDGE_RING"), history)
    two = C.commonality(C.lot_rates(predictions.unionByName(predictions), "EDGE_RING"), history)
    p = lambda t: {(r.step, r.tool): r.p for r in t.collect()}
    assert p(one) == p(two) and any(x is not None for x in p(one).values())


def test_null_history_has_no_candidate(spark):
    predictions, history = G.demo_lots(spark, seed=3, effect=0.0)
    table = C.commonality(C.lot_rates(predictions, "EDGE_RING"), history)
    assert table.filter("p_adj < 0.01").count() == 0


def test_small_tools_are_held(spark):
    rates = spark.createDataFrame([(str(i), i / 20) for i in range(12)], "lot string, rate double")
    history = spark.createDataFrame([(str(i), "s", "big" if i < 9 else "small") for i in range(12)], "lot string, step string, tool string")
    assert [r.p for r in C.commonality(rates, history).collect()] == [None, None]


def test_split_lot_history_is_rejected(spark):
    bad = spark.createDataFrame([("a", "ETCH", "1"), ("a", "ETCH", "2")], "lot string, step string, tool string")
    with pytest.raises(T.SplitLot):
        T.history(bad)


def test_missing_columns_are_named(spark):
    with pytest.raises(T.MissingInput, match="y_pred"):
        T.predictions(spark.createDataFrame([("a",)], "lot string"))


def test_threshold_meets_its_false_alarm_rate(spark):
    rng = np.random.default_rng(61)
    normal, defect = rng.gamma(2.0, 0.1, 700).round(3), rng.gamma(6.0, 0.12, 200).round(3)
    df = spark.createDataFrame([(float(x), False) for x in normal] + [(float(x), True) for x in defect] + [(None, False)], "p double, is_defect boolean")
    for r in M.operating_points(df.filter("p IS NOT NULL")).collect():
        assert r.threshold == pytest.approx(float(np.quantile(normal, 1 - r.far)))
        assert r.actual_far == pytest.approx(float((normal > r.threshold).mean())) and r.recall == pytest.approx(float((defect > r.threshold).mean()))
    assert {r.far: r.threshold for r in M.far_thresholds(df).collect()}.keys() == set(M.FAR)


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(67)
    rows = [(f"k{i % 3}", int(v), i, int(rng.integers(0, 9))) for i, v in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "k string, v int, id int, n int").repartition(7)
    for by, down in (((), False), (("k",), True)):
        order = [F.desc("v") if down else F.col("v"), F.col("id")]
        got = cumulated(df, order, {"before": F.col("n")}, by).collect()
        key = lambda r: (-r["v"] if down else r["v"], r["id"])
        for r in got:
            assert r.before == sum(o["n"] for o in got if key(o) < key(r) and (not by or o["k"] == r["k"]))


def test_threshold_without_normals_is_a_half(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True)], "p double, is_defect boolean")
    assert {r.threshold for r in M.far_thresholds(df).collect()} == {0.5}


def test_recall_is_monotone_in_far(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(rng.random() + (i % 4 == 0) * 0.3), i % 4 == 0) for i in range(400)], "p double, is_defect boolean")
    recall = [r.recall for r in sorted(M.recall_at_far(df).collect(), key=lambda r: r.far)]
    assert recall == sorted(recall)


def wafer(spark, mode, noise=0.0):
    d = G.sample_wafer(spark, mode, noise=noise).withColumn("wafer", F.lit(mode)).withColumn("v", F.when(F.col("status") == "FAIL", 2).otherwise(1))
    n = 15
    cells = d.withColumns({"x": (F.col("die_x") / 10 + n).cast("int"), "y": (F.lit(n) - F.col("die_y") / 10).cast("int"), "height": F.lit(2 * n + 1), "width": F.lit(2 * n + 1)})
    return cells.select("wafer", "height", "width", "x", "y", "v")


@pytest.fixture(scope="module")
def modes(spark):
    out = None
    for m in G.MODES:
        own = wafer(spark, m, 0.0 if m == "clean" else 0.01)
        out = own if out is None else out.unionByName(own)
    return out.persist()


def test_rules_agree_with_the_generator(spark, modes):
    found = R.classified(W.global_features(D.die_positions(modes))).collect()
    assert len(found) == len(G.MODES)
    for r in found:
        assert r.y_pred in expected_patterns(r.wafer), (r.wafer, r.y_pred)


def test_maps_round_trip(spark, modes):
    back = D.die_cells(D.die_map(modes)).select("wafer", "x", "y", F.col("v").cast("int").alias("v"))
    assert back.exceptAll(modes.select("wafer", "x", "y", "v")).count() == 0
    assert back.count() == modes.count()


def test_maps_of_odd_dies(spark):
    schema = "wafer int, lot string, height int, width int, x int, y int, v int"
    rows = [(1, "a", 2, 3, 2, 1, 2), (1, "a", 2, 3, 0, 0, 1), (1, "a", 2, 3, 1, 1, -3), (1, "a", 2, 3, 0, 7, 1), (1, "a", 2, 3, -1, 0, 1), (2, None, 2, 2, 1, 0, None), (3, "c", None, 2, 1, 0, 1)]
    found = D.die_map(spark.createDataFrame(rows, schema), carry=("lot",)).collect()
    assert {(r.wafer, r.lot): r.wafer_map for r in found} == {(1, "a"): [[1, 0, 0], [0, -3, 2]], (2, None): [[0, 0], [0, 0]], (3, "c"): None}
    for bad in ([(1, "a", 2, 3, 0, 0, 1), (1, "a", 2, 3, 0, 0, 2)], [(1, "a", 2, 3, None, 0, 1)]):
        with pytest.raises(SparkRuntimeException):
            D.die_map(spark.createDataFrame(bad, schema)).collect()


def test_large_maps_take_time_by_their_cells(spark):
    n = 220
    place = spark.range(n * n).filter("id % 5 <> 0")
    cells = place.select(F.lit(1).alias("wafer"), F.lit(n).alias("height"), F.lit(n).alias("width"), (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"), (F.col("id") % 2 + 1).alias("v"))
    began = time.perf_counter()
    got = D.die_map(cells).first().wafer_map
    assert time.perf_counter() - began < 20  # looked up die by die it takes minutes
    assert got == [[0 if i % 5 == 0 else i % 2 + 1 for i in range(y * n, y * n + n)] for y in range(n)]


def test_features_are_finite_and_point_the_right_way(spark, modes):
    f = {r.wafer: r for r in W.wafer_features(modes).collect()}
    for r in f.values():
        assert all(np.isfinite(r[c]) for c in W.FEATURES)
        assert 0 <= r.fail_frac <= 1 and 0 <= r.outer_cover <= 1
    assert f["ring"].outer_cover > f["edge_loc"].outer_cover
    assert f["scratch"].elongation > f["center"].elongation
    assert f["random"].n_comp > f["ring"].n_comp
    assert f["center"].prof0 > 1 > f["ring"].prof0


def test_a_wafer_without_fails_is_safe(spark):
    cells = wafer(spark, "clean")
    row = W.wafer_features(cells).first()
    assert row.fail_frac == 0 and row.elongation == 1 and row.big_len == 0 and row.prof0 == 1


def test_empty_tables_give_empty_results(spark, modes):
    none = modes.filter("wafer = 'nothing'")
    assert W.wafer_features(none).count() == 0
    assert D.infer_geometry(D.die_positions(none)).count() == 0
    assert R.classified(W.global_features(D.die_positions(none))).count() == 0


def test_generator_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        G.sample_wafer(spark, "spiral")
    with pytest.raises(ValueError):
        G.sample_wafer(spark, noise=1.5)


def test_parametric_field_yield(spark):
    f = G.parametric_field(spark, "clean").withColumn("wafer", F.lit(1))
    row = D.spec_yield(f).first()
    assert row.n_die == f.filter("z IS NOT NULL").count() and row.yield_pct > 95


def test_calibration_equals_a_plain_search(spark, modes):
    truth = F.element_at(F.create_map(*[F.lit(x) for m in G.MODES for x in (m, expected_patterns(m)[0])]), F.col("wafer"))
    f = W.wafer_features(modes).withColumn("y_true", truth).persist()
    for structural, names in ((False, ("loc_dir", "edge_r")), (True, ("ring_cover_min", "random_ncomp_min"))):
        all_grids = R.STRUCTURAL_GRIDS if structural else R.GRIDS
        grids = {n: all_grids[n][::4] for n in names}
        best, f1 = R.calibrate(f, grids=grids, passes=2, structural=structural)
        of = lambda p: R.sweep(f, p, "clean_frac", [p["clean_frac"]], structural).first()["macro_f1"]  # noqa: E731, B023
        p = {**R.CALIBRATED, **R.DEFAULT} if structural else dict(R.DEFAULT)
        for _ in range(2):
            for n in names:
                gains = [of({**p, n: v}) for v in grids[n]]
                if max(gains) > of(p) + 1e-6:
                    p = {**p, n: grids[n][gains.index(max(gains))]}
        assert best == p and f1 == pytest.approx(of(p))


def test_thresholds_and_grids_are_those_of_the_contract():
    # Written out once more, as the SQL of the rules takes them from the code under test.
    assert [R.DEFAULT[k] for k in ("center_r", "edge_r", "ring_std", "donut_lo", "donut_hi", "scratch_axial", "loc_dir")] == [0.30, 0.70, 0.15, 0.35, 0.70, 0.50, 0.50]
    assert [R.CALIBRATED[k] for k in ("nearfull_frac", "center_r", "ring_cover_min", "scratch_elong_min", "random_ncomp_min")] == [0.75, 0.74, 0.70, 3.00, 15.0]
    sizes = {k: (len(v), v[0], v[-1]) for k, v in R.STRUCTURAL_GRIDS.items()}
    assert sizes["center_r"] == (23, 0.40, 0.84) and sizes["edge_r"] == (15, 0.62, 0.90) and sizes["ring_cover_min"] == (13, 0.40, 1.0)
    assert sizes["scratch_largest_min"] == (8, 0.10, 0.80) and sizes["donut_std"] == (11, 0.14, 0.34) and sizes["clean_frac"] == (5, 0.0, 0.04)


def test_macro_f1_ignores_a_ninth_class(spark):
    df = spark.createDataFrame([(c, c) for c in CLASSES] + [("LOC", "CLEAN")], "y_true string, y_pred string")
    assert M.macro_f1(df).first()["macro_f1"] == pytest.approx((7 + 2 / 3) / 8)


def test_demo_shift_is_found(spark):
    # A seed without chance alarms before the shifts: each is found within 600 wafers of its start.
    rows = G.demo_predictions(spark, seed=1).withColumn("idx", F.col("sample_id"))
    found = S.first_detection(S.alarms(S.build_charts(rows, CLASSES, 25, 2500)))
    first = {r.chart: r.first_idx for r in found.groupBy("chart").agg(F.min("first_idx").alias("first_idx")).collect()}
    for chart, start in (("EDGE_RING", 3000), ("LOW_CONFIDENCE", 3750), ("SCRATCH", 4125)):
        assert start <= first[chart] <= start + 600, (chart, first[chart])


def test_demo_confidence_follows_its_distribution(spark):
    c = np.array([r.confidence for r in G.demo_predictions(spark, groups=150).collect()])  # none of them aged
    early = c[: 112 * 25]
    assert abs(early.mean() - 8 / 9.2) < 0.01 and abs(early.var() - 8 * 1.2 / (9.2**2 * 10.2)) < 0.002 and 0 < early.min() < early.max() < 1


def test_maps_of_many_sizes(spark):
    raw = G.labelled_maps(spark, lots=6, unlabelled=4, none_lots=3, seed=2).persist()
    rows = raw.collect()
    assert len({len(r.wafer_map) for r in rows}) > 3 and all(len(r.wafer_map) == len(x) for r in rows for x in r.wafer_map)
    assert sum(not r.failure_type for r in rows) == 4
    known = T.labelled(raw, include_none=True)
    assert known.count() == len(rows) - 4 and T.labelled(raw).count() < known.count()
    cells = D.die_cells(known.withColumn("wafer", F.struct("lot", "wafer_index")).select("wafer", "wafer_map", "y_true"))
    f = W.wafer_features(cells, carry=("y_true",)).collect()
    assert len(f) == known.count() and all(np.isfinite(r[c]) for r in f for c in W.FEATURES)
    share = lambda name: [r.fail_frac for r in f if r.y_true == name]
    assert max(share("NONE")) < 0.12 and all(x > 0.5 for x in share("NEAR_FULL"))


def test_kept_features_are_read_again(spark, modes, tmp_path, monkeypatch):
    one = W.feature_table(modes, str(tmp_path)).collect()
    monkeypatch.setattr(W, "wafer_features", lambda *a, **k: pytest.fail("computed again"))
    assert sorted(W.feature_table(modes, str(tmp_path)).collect()) == sorted(one)
    monkeypatch.setattr(W, "FEATURE_VERSION", "other")
    with pytest.raises(pytest.fail.Exception):
        W.feature_table(modes, str(tmp_path))


def test_predictions_from_a_file_in_any_column_order(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\ufeffy_pred,lot,extra,skipped,confidence\nLOC,7,x,false,0.5\nLOC,8,x,true,0.5\n,9,x,false,0.1\n", encoding="utf-8")
    rows = T.read_predictions(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.lot, r.y_pred, r.confidence, r.extra) for r in rows] == [("7", "LOC", 0.5, "x")]
    timed = spark.createDataFrame([("a", "X", t, i) for i, t in enumerate(["2024-01-02 00:00:00", None, "2024-01-01 05:00:00", "2024-01-01 05:00:00"])], "lot string, y_pred string, t string, n int")
    timed = timed.withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r.n: r.idx for r in T.predictions(timed, "t", ("n",)).collect()} == {2: 0, 3: 1, 0: 2, 1: 3}


def test_named_outputs_are_read_back(spark, tmp_path):
    paths = T.save_all({"alarms": spark.range(3), "subgroups": spark.range(5)}, str(tmp_path))
    assert spark.read.parquet(paths["alarms"]).count() == 3 and spark.read.parquet(paths["subgroups"]).count() == 5
    paths = T.save_all({"LOC": spark.range(2)}, str(tmp_path / "csv"), "csv")
    assert T.read_csv(spark, paths["LOC"], "id long").count() == 2
    assert T.first_existing(spark, [str(tmp_path / "no/where"), str(tmp_path / "alarms")]).count() == 3
    with pytest.raises(T.MissingInput):
        T.first_existing(spark, [str(tmp_path / "no/where")])


def vectors(spark, n=400, lots=20):
    """Rows whose class shows in the first feature; the others are noise."""
    rng = np.random.default_rng(71)
    kind = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 3))
    x[:, 0] += 4 * kind
    names = [CLASSES[k] for k in kind]
    return spark.createDataFrame([(i, f"lot{i % lots}", c, c == CLASSES[2], *map(float, v)) for i, (c, v) in enumerate(zip(names, x, strict=True))], "id int, lot string, y_true string, is_defect boolean, a double, b double, c double")


def test_folds_are_whole_groups_of_like_size(spark):
    rng = np.random.default_rng(73)
    rows = [(lot, i) for lot in range(41) for i in range(int(rng.integers(1, 40)))]
    out = L.group_folds(spark.createDataFrame(rows, "lot int, i int")).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("lot").alias("lots")).collect()
    sizes = [r.n for r in out]
    assert len(out) == 4 and sum(r.lots for r in out) == 41 and max(sizes) - min(sizes) <= 40


def test_split_takes_a_share_of_lots(spark):
    df = vectors(spark)
    for seed in (0, 1):
        out = L.lot_split(df, seed)
        assert out.filter("is_test").select("lot").distinct().count() == 6 and out.count() == 400
    assert L.lot_split(df.filter("id < 0"), 0).count() == 0


def test_searches_over_folds_and_paired_fits(spark):
    df, names = vectors(spark), ["a", "b", "c"]
    out = L.searched_tree(df, names, depths=(1, 3), folds=2).select("y_true", "y_pred").collect()
    assert sum(r.y_true == r.y_pred for r in out) > 0.85 * len(out) == 0.85 * 120
    scan = L.leaf_scan(df, names, leaves=(2, 200), trees=5, folds=2)
    assert [k for k, *_, chosen in scan if chosen] == [2] and scan[0][2] > scan[1][2]
    fits = L.paired_fits(df, {"good": (L.forest(5), names), "noise": (L.forest(5), names[1:])}, seeds=(0, 1))
    table = {r.model: r for r in M.paired_models(fits, "noise").collect()}
    between = {r.model: r for r in L.gaps(fits).collect()}
    assert between["noise"].gap > 0.1 > between["good"].gap and between["good"].gap == pytest.approx(between["good"].train - between["good"].test)
    assert table["good"].wins == 2 and table["good"].mean_gain > 0.2 and table["noise"].wins == 0
    assert "a <=" in L.tree_text(df, names, depth=2)


def test_cascade_scores_rows_out_of_fold(spark):
    df, names = vectors(spark), ["a", "b", "c"]
    out = L.out_of_fold(df, names, trees=5)
    assert out.count() == 400
    ends = M.operating_points(out, grid=(0.05,)).first()
    assert ends.recall > 0.8 and ends.actual_far < 0.08
    none = out.withColumns({"y_true": F.when(F.col("is_defect"), F.col("y_true")).otherwise("NONE"), "y_pred": F.lit(CLASSES[2])})
    r = M.end_to_end(M.cascade(none, 0.5)).first()
    assert r.none_recall > 0.85 and r.none_precision > 0.85 and 0.2 < r.review_frac < 0.5


def test_labels_are_unwrapped(spark):
    raw = spark.createDataFrame(
        [("l", 1, [[1, 2]], [["Donut"]]), ("l", 2, [[1, 2]], []), ("l", 3, [[1, 2]], [["none"]])],
        "lot string, wafer_index int, wafer_map array<array<tinyint>>, failure_type array<array<string>>",
    )
    assert [r.y_true for r in T.labelled(raw).collect()] == ["DONUT"]
    assert T.labelled(raw, include_none=True).count() == 2
    assert {r.ftype: r.n for r in T.label_distribution(raw).collect()} == {"Donut": 1, None: 1, "none": 1}
    assert T.map_shapes(raw).first()["n_shapes"] == 1


def test_stream_of_windows_raises_alarms(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("y_pred"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = beyond_limits(window_shares(stream, "error", width="1 day"), 0.2)
    q = out.writeStream.outputMode("complete").format("memory").queryName("shares").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) AS n, count_if(alarm) AS alarms FROM shares").first()
    days = {}
    for r in events.collect():
        n, hits = days.get(r.ts.date(), (0, 0))
        days[r.ts.date()] = n + 1, hits + (r.y_pred == "error")
    beyond = sum(abs(hits / n - 0.2) > 3 * (0.16 / n) ** 0.5 for n, hits in days.values())
    assert got.n == events.count() and got.alarms == beyond


def test_windows_beyond_limits(spark):
    rows = [("2024-01-01 00:10:00", "X" if i < k else "Y", h) for h, k in ((0, 20), (1, 70), (2, 3)) for i in range(100)]
    df = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", p) for _, p, h in rows], "ts string, y_pred string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.start.hour, r.alarm) for r in beyond_limits(window_shares(df, "X"), 0.2).collect())
    assert [a for _, a in got] == [False, True, True]
