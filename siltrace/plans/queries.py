"""The registered wafer queries: (spark, sf_dir) -> DataFrame, doubles rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.operators import commonality as C
from siltrace.operators import dies as D
from siltrace.operators import features as W
from siltrace.operators import metrics as M
from siltrace.operators import ml as L
from siltrace.operators import report as P
from siltrace.operators import rules as R
from siltrace.operators import spc as S
from siltrace.operators.audit import classify_all as classify_all_maps
from siltrace.operators.detection import detection_summary, detection_verdicts
from siltrace.plans import adapters as A
from siltrace.sources import tables as T
from siltrace.sources.dimensions import CLASSES, EXPECTED, RAW_LABELS, expected_patterns, mapped
from siltrace.sources.stored import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
BASE_SIZE = 25


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, integers as long."""
    out = {"double": lambda c: F.round(c, 6), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[out[t](c).alias(c) if t in out else F.col(c) for c, t in df.dtypes])


# --- wafers ---


def _global(spark: SparkSession, sf: str) -> DataFrame:
    return W.global_features(D.die_positions(A.wafer_cells(spark, sf)), carry=("lot", "pm", "y_true"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return W.wafer_features(A.wafer_cells(spark, sf), carry=("lot", "pm", "y_true"))


def _rounded_features(spark: SparkSession, sf: str) -> DataFrame:
    """All features without the rounding noise that would tell ties apart."""
    digits = lambda c: 3 if c == "elongation" else 6
    return written(_features(spark, sf).select("wafer", "y_true", *[F.round(c, digits(c)).alias(c) for c in W.FEATURES]), "rounded-features")


def _boxed(spark: SparkSession, sf: str) -> DataFrame:
    return W.with_box(A.wafer_cells(spark, sf))


def _components(spark: SparkSession, sf: str) -> DataFrame:
    return W.component_features(W.component_table(_boxed(spark, sf)))


@query
def rule_classify(spark, sf):
    return tidy(R.classified(_global(spark, sf)).select("wafer", "lot", "y_true", "y_pred"))


@query
def rule_score(spark, sf):
    return tidy(R.classified(_global(spark, sf)).select("wafer", "y_pred", "score"))


@query
def wafer_yield(spark, sf):
    return tidy(D.wafer_yield(A.wafer_cells(spark, sf)))


@query
def die_explode(spark, sf):
    p = D.die_positions(A.wafer_cells(spark, sf))
    return tidy(p.select("wafer", "x", "y", "die_x", "die_y", "radius", "angle_deg", "status"))


@query
def map_roundtrip(spark, sf):
    maps = D.die_map(A.wafer_cells(spark, sf))
    return tidy(D.die_cells(maps).select("wafer", "height", "width", "x", "y", F.col("v").cast("long").alias("v")))


@query
def geometry_infer(spark, sf):
    return tidy(D.infer_geometry(D.die_positions(A.wafer_cells(spark, sf))))


@query
def global_features(spark, sf):
    return tidy(_global(spark, sf).select("wafer", "n_die", "n_fail", *W.GLOBAL))


@query
def clean_zeroing(spark, sf):
    """Statistics of near-clean wafers before zeroing, beside the zeroed ones."""
    p = D.die_positions(A.wafer_cells(spark, sf))
    raw = W.global_features(p, zeroing=False).filter(F.col("fail_frac") <= W.CLEAN_FRAC)
    held = W.global_features(p).select("wafer", F.col("r_mean").alias("r_mean_held"), F.col("dir_c").alias("dir_c_held"))
    return tidy(raw.join(held, "wafer").select("wafer", "fail_frac", "r_mean", "dir_c", "r_mean_held", "dir_c_held"))


@query
def rule_param_global(spark, sf):
    p = {k: v for k, v in R.CALIBRATED.items() if k in R.DEFAULT}
    return _global(spark, sf).select("wafer", R.pattern(p).alias("y_pred"))


@query
def rule_param_struct(spark, sf):
    return _features(spark, sf).select("wafer", R.pattern(R.CALIBRATED, structural=True).alias("y_pred"))


@query
def calib_sweep(spark, sf):
    return tidy(R.sweep(_global(spark, sf), R.DEFAULT, "center_r", R.GRIDS["center_r"]))


@query
def calibrated_rules(spark, sf):
    """Rules calibrated on training lots, applied to all wafers."""
    g = written(L.lot_split(_global(spark, sf), seed=42), "split")
    best, _ = R.calibrate(g.filter("NOT is_test"))
    return g.select("wafer", "is_test", "y_true", R.pattern(best).alias("y_pred"))


@query
def calibrated_structural(spark, sf):
    """Rules with structural parameters calibrated on training lots, applied to all wafers."""
    f = written(L.lot_split(_features(spark, sf), seed=42), "split")
    best, _ = R.calibrate(f.filter("NOT is_test"), structural=True)
    return f.select("wafer", "is_test", "y_true", R.pattern(best, structural=True).alias("y_pred"))


@query
def radial_profile(spark, sf):
    return tidy(W.structural_die_features(_boxed(spark, sf)).select("wafer", *W.PROFILE))


@query
def angular_cover(spark, sf):
    return tidy(W.structural_die_features(_boxed(spark, sf)).select("wafer", "outer_cover", "outer_rate"))


@query
def components(spark, sf):
    """Label of every failing die: the raster index of its component's first cell."""
    from siltrace.operators.components import _STRIDE, label_components

    cells = label_components(A.wafer_cells(spark, sf).filter("v = 2").select("wafer", "x", "y"))
    first = F.floor(F.col("comp") / _STRIDE) * A.SIDE + F.col("comp") % _STRIDE
    return tidy(cells.select("wafer", "x", "y", first.alias("comp")))


@query
def component_sizes(spark, sf):
    return tidy(_components(spark, sf).select("wafer", "n_comp", "largest_frac", "comp_size_mean", "isolated_frac", "n_comp_sig", "sig_frac", "second_frac"))


@query
def elongation(spark, sf):
    return _components(spark, sf).select("wafer", F.round("elongation", 3).alias("elongation"))


@query
def largest_position(spark, sf):
    return tidy(_components(spark, sf).select("wafer", *W.POSITION))


@query
def neighbour_mean(spark, sf):
    return tidy(_components(spark, sf).select("wafer", "fail_nb_mean"))


@query
def big_shape(spark, sf):
    return tidy(_components(spark, sf).select("wafer", "big_extent", "big_len"))


@query
def edge_touch(spark, sf):
    return tidy(_components(spark, sf).select("wafer", "big_edge_touch"))


@query
def features28(spark, sf):
    f = _features(spark, sf)
    return tidy(f.withColumn("elongation", F.round("elongation", 3)))


@query
def expected_match(spark, sf):
    """Verdicts that agree with the planted pattern; a blob among scattered fails may look random."""
    v = R.classified(_global(spark, sf))
    allowed = {p: (p,) for p in A.PLANTED} | {expected_patterns(m)[0]: expected_patterns(m) for m in EXPECTED} | {"LOC": ("LOC", "RANDOM")}
    names = F.create_map(*[x for p, own in allowed.items() for x in (F.lit(p), F.array(*[F.lit(o) for o in own]))])
    return tidy(v.select("wafer", "y_true", "y_pred", F.array_contains(F.element_at(names, F.col("y_true")), F.col("y_pred")).alias("matched")))


@query
def labelled_wafers(spark, sf):
    """Wafers with a known label out of nested ones; every seventh has an empty label."""
    return tidy(T.labelled(_raw_maps(spark, sf), include_none=True).select("lot", "wafer_index", "y_true", F.size("wafer_map").alias("height")))


@query
def raw_labels(spark, sf):
    return T.label_distribution(_raw_maps(spark, sf))


@query
def map_shapes(spark, sf):
    """Distinct shapes of maps, cut to their dies' rows."""
    m = _raw_maps(spark, sf)
    cut = F.filter("wafer_map", lambda row, i: (F.col("wafer_index") % 3 != 0) | (i >= F.col("wafer_index") % 4))
    return T.map_shapes(m.withColumn("wafer_map", cut))


def _raw_maps(spark: SparkSession, sf: str) -> DataFrame:
    maps = D.die_map(A.wafer_cells(spark, sf), carry=("lot", "y_true"))
    raw = {v: k for k, v in RAW_LABELS.items()} | {"CLEAN": "none"}
    label = mapped(raw, F.col("y_true"))
    nested = F.when(F.col("wafer") % 7 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(label)))
    return maps.select("lot", F.col("wafer").alias("wafer_index"), "wafer_map", nested.alias("failure_type"))


@query
def action_lookup(spark, sf):
    return P.with_actions(R.classified(_global(spark, sf))).select("wafer", "y_pred", "action")


@query
def quality_filter(spark, sf):
    """Wafers with too few dies are kept as skipped."""
    s = D.sized(A.wafer_cells(spark, sf).filter(~((F.col("wafer") % 10 == 0) & (F.col("x") > 6))))
    return tidy(s.groupBy("wafer").agg(F.first("n_die").alias("n_die"), F.first("skipped").alias("skipped")))


@query
def classify_all(spark, sf):
    """Every wafer with its verdict or why it has none; some maps are cut down, made ragged, given an unknown code or taken away."""
    wafer = F.col("wafer")
    cells = A.wafer_cells(spark, sf).filter(~((wafer % 10 == 0) & (F.col("x") > 4)))
    maps = D.die_map(cells).join(cells.select("wafer", "lot", "y_true").distinct(), "wafer")
    m, rest = F.col("wafer_map"), F.slice("wafer_map", F.lit(2), F.size("wafer_map") - 1)
    first = F.get(m, 0)
    ragged = F.concat(F.array(F.slice(first, F.lit(2), F.size(first) - 1)), rest)
    coded = F.concat(F.array(F.concat(F.array(F.lit(9).cast("tinyint")), F.slice(first, F.lit(2), F.size(first) - 1))), rest)
    broken = F.when(wafer % 11 == 5, F.lit(None)).when(wafer % 7 == 3, ragged).when(wafer % 13 == 6, coded).otherwise(m)
    return tidy(classify_all_maps(maps.withColumn("wafer_map", broken), carry=("lot", "y_true")))


@query
def spec_yield(spark, sf):
    """A measured field over the grid, judged by its limits."""
    d = A.wafer_cells(spark, sf)
    rn = F.sqrt(((F.col("x") - 15) * (F.col("x") - 15) + (F.col("y") - 15) * (F.col("y") - 15)).cast("double")) / 15.0
    z = 435.0 - 4.0 * rn - F.when(F.col("v") == 2, 45.0).otherwise(0.0)
    field = d.select("wafer", F.when(F.col("x") != 15, z).alias("z"), F.lit(413.25).alias("spec_lo"), F.lit(456.75).alias("spec_hi"))
    return tidy(D.spec_yield(field))


@query
def title_stats(spark, sf):
    cells = A.wafer_cells(spark, sf)
    return tidy(P.title_stats(D.wafer_yield(cells), R.classified(W.global_features(D.die_positions(cells))).select("wafer", "y_pred")))


@query
def lot_summary(spark, sf):
    v = R.classified(_global(spark, sf)).withColumn("yield_pct", (1.0 - F.col("fail_frac")) * 100.0)
    return tidy(P.lot_summary(v.select("lot", F.col("y_pred").alias("pattern"), "yield_pct", (F.col("y_pred") == F.col("y_true")).alias("matched"))))


# --- metrics over verdicts and features ---


@query
def label_dist(spark, sf):
    return _global(spark, sf).groupBy("y_true").agg(F.count("*").alias("n"))


@query
def class_feature_medians(spark, sf):
    v = R.classified(_global(spark, sf))
    return tidy(M.class_medians(v, ("fail_frac", "r_mean", "r_std", "dir_c", "axial_c")))


def _nine(v: DataFrame, *keep: str) -> DataFrame:
    none = lambda c: F.when(F.col(c) == "CLEAN", "NONE").otherwise(F.col(c)).alias(c)
    return v.select("wafer", *keep, none("y_true"), none("y_pred"))


@query
def confusion9(spark, sf):
    return tidy(M.confusion(_nine(R.classified(_global(spark, sf)))))


@query
def class_report(spark, sf):
    return tidy(M.class_report(R.classified(_global(spark, sf))))


@query
def macro_f1(spark, sf):
    v = R.classified(_global(spark, sf))
    present = M.macro_f1(v, only_present=True).select(F.col("macro_f1").alias("macro_f1_present"))
    return tidy(M.macro_f1(v).select("macro_f1").crossJoin(present))


@query
def balanced_acc(spark, sf):
    v = R.classified(_global(spark, sf))
    accuracy = v.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    return tidy(M.macro_f1(v, labels=(*CLASSES, "CLEAN")).select("balanced_accuracy").crossJoin(accuracy))


@query
def auc_ovr_table(spark, sf):
    return tidy(M.auc_table(_rounded_features(spark, sf), W.FEATURES))


@query
def auc_rank(spark, sf):
    return tidy(M.auc_ranking(M.auc_table(_rounded_features(spark, sf), W.FEATURES)).select("name", "feature", "auc"))


@query
def roc_points(spark, sf):
    return tidy(M.roc_points(A.detection_scores(spark, sf)))


@query
def avg_precision(spark, sf):
    return tidy(M.average_precision(A.detection_scores(spark, sf)))


@query
def recall_at_far(spark, sf):
    return tidy(M.recall_at_far(A.detection_scores(spark, sf)))


@query
def far_threshold(spark, sf):
    return tidy(M.far_thresholds(A.detection_scores(spark, sf)))


@query
def operating_points(spark, sf):
    return tidy(M.operating_points(A.detection_scores(spark, sf)))


@query
def miss_table(spark, sf):
    s = A.detection_scores(spark, sf).filter("is_defect").withColumn("flagged", F.col("p") > 0.5)
    return tidy(M.miss_table(s))


@query
def cascade_eval(spark, sf):
    """Verdicts behind a first stage on the fail fraction, against a perfect first stage."""
    v = M.cascade(_nine(R.classified(_global(spark, sf)), "fail_frac"), 0.05, p="fail_frac").withColumn("y_perfect", F.when(F.col("y_true") == "NONE", "NONE").otherwise(F.col("y_pred")))
    ends = M.macro_f1(v, pred="y_cascade").select(F.col("macro_f1").alias("f1_cascade"))
    return tidy(ends.crossJoin(M.macro_f1(v, pred="y_perfect").select(F.col("macro_f1").alias("f1_perfect"))))


@query
def paired_models(spark, sf):
    """Default and calibrated rules over five folds of lots taken as seeds."""
    g = _global(spark, sf).withColumn("seed", F.col("lot") % 5)
    p = {k: v for k, v in R.CALIBRATED.items() if k in R.DEFAULT}
    rows = g.select("seed", "y_true", F.inline(F.array(F.struct(F.lit("default").alias("model"), R.pattern().alias("y_pred")), F.struct(F.lit("calibrated").alias("model"), R.pattern(p).alias("y_pred")))))
    f1 = M.macro_f1(rows, by=("model", "seed")).select("model", "seed", F.col("macro_f1").alias("f1"))
    return tidy(M.paired_models(f1, "default"))


@query
def pairwise_auc(spark, sf):
    """How features tell patterns apart that are often mistaken for each other."""
    return tidy(M.pairwise_auc(_rounded_features(spark, sf), W.FEATURES, (("EDGE_LOC", "LOC"), ("SCRATCH", "LOC"))))


@query
def cascade_none(spark, sf):
    """What a first stage on the fail fraction passes as free of patterns."""
    v = _nine(R.classified(_global(spark, sf)), "fail_frac")
    return tidy(M.end_to_end(M.cascade(v, 0.05, p="fail_frac")))


@query
def operating_curve(spark, sf):
    """Recall at each false-alarm rate over four groups of sources."""
    s = A.detection_scores(spark, sf).withColumn("seed", F.col("doc_id") % 4)
    cuts = M.far_thresholds(s)
    points = s.filter("is_defect").crossJoin(F.broadcast(cuts)).groupBy("seed", "far").agg(F.avg((F.col("p") > F.col("threshold")).cast("double")).alias("recall"))
    return tidy(M.operating_curve(points))


# --- process control ---


def _rows(spark: SparkSession, sf: str, planted: bool = False, optional: bool = False) -> DataFrame:
    rows = A.spc_rows(spark, sf, planted)
    kept = rows if optional else rows.drop("confidence", "fail_frac")
    return S.numbered(kept, ("ts", "event_id"))


def _charts(spark: SparkSession, sf: str, planted: bool = True, optional: bool = False, laney: bool = True) -> DataFrame:
    """Half the stream is the baseline."""
    rows = _rows(spark, sf, planted, optional)
    return S.build_charts(rows, EVENT_TYPES, BASE_SIZE, _half(spark, sf), laney=laney)


def _half(spark: SparkSession, sf: str) -> int:
    return A.read(spark, sf, "events").count() // 2


@query
def subgroups_fixed(spark, sf):
    hits = S.chart_rows(_rows(spark, sf), EVENT_TYPES)
    total = hits.agg((F.max("idx") + 1).alias("total"))
    return tidy(S.subgroups(S.fixed_groups(hits.crossJoin(F.broadcast(total)), F.lit(30), F.col("total"))))


@query
def ordered_predictions(spark, sf):
    """Usable predictions in order of time: every eleventh is skipped, every thirteenth has no verdict."""
    rows = A.spc_rows(spark, sf).select("ts", "event_id", F.col("run_lot").alias("lot"), "y_pred")
    rows = rows.withColumns({"skipped": F.col("event_id") % 11 == 0, "y_pred": F.when(F.col("event_id") % 13 != 0, F.col("y_pred"))})
    return tidy(T.predictions(rows, "ts", ("event_id",)).select("event_id", "lot", "y_pred", "idx"))


@query
def p_chart_by_lot(spark, sf):
    """Charts whose subgroups are whole runs of lots."""
    rows = _rows(spark, sf).withColumn("lot", F.col("run_lot"))
    c = S.build_charts(rows, EVENT_TYPES, BASE_SIZE, _half(spark, sf), by_lot=True)
    return tidy(c.select("chart", "i", "n", "count", "end_idx", "value", "center", "sigma", "z"))


@query
def subgroups_by_lot(spark, sf):
    rows = _rows(spark, sf).withColumn("lot", F.col("run_lot"))
    runs = S.lot_runs(rows)
    return tidy(runs.join(S.lot_groups(runs, 50), "run").select("run", "first_idx", "size", "lot", "gid"))


@query
def adaptive_size(spark, sf):
    return tidy(S.adaptive_sizes(S.chart_rows(_rows(spark, sf, optional=True), EVENT_TYPES), BASE_SIZE, _half(spark, sf)))


@query
def p_chart(spark, sf):
    c = _charts(spark, sf, planted=False)
    return tidy(c.select("chart", "i", "n", "count", "end_idx", "lots", "value", "center", "sigma", "z", "ucl", "lcl"))


@query
def laney_factor(spark, sf):
    return tidy(_charts(spark, sf, planted=False).select("chart", "sigma_z", "n_base").distinct())


@query
def imr_chart(spark, sf):
    c = _charts(spark, sf, planted=False, optional=True)
    return tidy(c.filter("chart = 'FAIL_FRAC_MEAN'").select("chart", "i", "value", "center", "sigma", "z"))


@query
def western_electric(spark, sf):
    return tidy(_charts(spark, sf).select("chart", "i", "R1", "R2", "R3", "R4"))


@query
def ewma(spark, sf):
    return tidy(_charts(spark, sf).select("chart", "i", "ewma", "ewma_limit", "above_ewma"))


@query
def alarm_log(spark, sf):
    return tidy(S.alarms(_charts(spark, sf)))


@query
def first_detection(spark, sf):
    return tidy(S.first_detection(S.alarms(_charts(spark, sf))))


@query
def rule_pivot(spark, sf):
    return S.rule_pivot(S.first_detection(S.alarms(_charts(spark, sf))))


@query
def baseline_alarm_rate(spark, sf):
    points = _charts(spark, sf)
    return tidy(S.baseline_alarm_rate(points, S.alarms(points)))


# --- commonality ---


def _traced(spark: SparkSession, sf: str, planted: bool = True) -> tuple[DataFrame, DataFrame]:
    return written(C.lot_rates(A.history_hits(spark, sf, planted), hit="hit"), "rates"), written(A.process_history(spark, sf), "history")


def _tested(rates: DataFrame, history: DataFrame) -> DataFrame:
    return written(C.commonality(rates, history), "commonality")


@query
def lot_rates(spark, sf):
    return tidy(_traced(spark, sf)[0])


@query
def history_dups(spark, sf):
    """Visits of a lot to two tools in one step, after every third lot's step 2 is given another tool."""
    h = A.process_history(spark, sf)
    twice = h.filter("step = 2 AND lot % 3 = 0").withColumn("tool", F.col("tool") + 10)
    return tidy(T.history_duplicates(h.unionByName(twice)))


@query
def commonality(spark, sf):
    return tidy(C.commonality(*_traced(spark, sf)))


@query
def bh_adjust(spark, sf):
    """Adjustment of p values k / 997 with some held back."""
    p = A.process_history(spark, sf).select("step", "tool").distinct()
    n = (F.col("step") * 37 + F.col("tool") * 101) % 97
    return tidy(C.bh_adjust(p.withColumn("p", F.when(n % 7 != 0, n / 997.0))))


@query
def confounding(spark, sf):
    rates, history = _traced(spark, sf)
    t = C.confounding(rates, history, _tested(rates, history))
    return tidy(t.select("step", "tool", "p_adj", "place", "confounded_with"))


@query
def verdict(spark, sf):
    rates, history = _traced(spark, sf)
    t = C.verdicts(C.confounding(rates, history, _tested(rates, history)))
    return tidy(t.select("step", "tool", "place", "verdict"))


@query
def top_per_pattern(spark, sf):
    """The first candidate with and without the planted cause."""
    parts = []
    for name, planted in (("planted", True), ("null", False)):
        t = C.ranked_candidates(C.commonality(*_traced(spark, sf, planted))).filter("place = 1")
        parts.append(t.select(F.lit(name).alias("pattern"), "step", "tool", "delta", "p_adj", (F.col("p_adj") < C.ALPHA).alias("significant")))
    return tidy(parts[0].unionByName(parts[1]))


@query
def tool_rates(spark, sf):
    rates, history = _traced(spark, sf)
    return tidy(C.tool_rates(rates, history, _tested(rates, history)))


@query
def lot_overlap(spark, sf):
    """Lots rated and with a history, against lots of either."""
    rates, history = _traced(spark, sf)
    a, b = rates.filter("rate > 0.3").select("lot"), history.filter("tool = 2").select("lot")
    return tidy(a.intersect(b).agg(F.count("*").alias("both")).crossJoin(a.union(b).distinct().agg(F.count("*").alias("either"))))


# --- splits and trees ---


@query
def lot_split(spark, sf):
    return L.lot_split(_global(spark, sf), seed=42).select("wafer", "lot", "is_test")


@query
def lot_folds(spark, sf):
    return tidy(L.group_folds(_global(spark, sf)).select("wafer", "lot", "fold"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    e = A.read(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 40).alias("lot"), (F.col("label") == 0).alias("is_defect"), *[F.get("embedding", i).cast("double").alias(n) for i, n in enumerate(names)]), names


def _kept_features(spark: SparkSession, sf: str) -> DataFrame:
    return written(_features(spark, sf), "features")


@query
def oof_scores(spark, sf):
    rows, names = _vectors(spark, sf)
    return tidy(L.out_of_fold(rows, names).select("vec_id", "lot", "fold", "is_defect", "p"))


@query
def tree_pred(spark, sf):
    return L.searched_tree(_kept_features(spark, sf), W.FEATURES[:17]).select("wafer", "lot", "y_true", "y_pred")


@query
def rf_pred(spark, sf):
    return L.trained_predictions(_kept_features(spark, sf), W.FEATURES[:20], L.forest()).select("wafer", "lot", "y_true", "y_pred")


@query
def boost_pred(spark, sf):
    """A booster of 50 rounds."""
    return L.trained_predictions(_kept_features(spark, sf), W.FEATURES, L.boosted(iterations=50)).select("wafer", "lot", "y_true", "y_pred")


@query
def leaf_scan(spark, sf):
    """Forests by least rows in a leaf; 50 trees each."""
    rows = L.leaf_scan(_kept_features(spark, sf), W.FEATURES[:20], trees=50)
    return tidy(spark.createDataFrame(rows, "leaf int, inner double, train double, test double, chosen boolean"))


@query
def paired_forests(spark, sf):
    """Forests on 17 and on 20 features over the same five splits; 50 trees each."""
    models = {f"RF-{n}": (L.forest(trees=50), W.FEATURES[:n]) for n in (17, 20)}
    return tidy(M.paired_models(L.paired_fits(_kept_features(spark, sf), models), "RF-20"))


@query
def tree_pred_extended(spark, sf):
    """The second grid of depths, on the features of the extended rules."""
    return L.searched_tree(_kept_features(spark, sf), W.FEATURES[:17], depths=L.EXTENDED_DEPTHS).select("wafer", "lot", "y_true", "y_pred")


@query
def detection(spark, sf):
    """Detection at a false-alarm rate of 2 % and the second stage behind it, over one split of lots."""
    rows = _kept_features(spark, sf).withColumn("y_true", F.when(F.col("y_true") == "CLEAN", "NONE").otherwise(F.col("y_true")))
    verdicts, _ = detection_verdicts(rows, W.FEATURES, W.FEATURES[:20], keep=("wafer",), seeds=(42,))
    return tidy(detection_summary(written(verdicts, "verdicts")))


@query
def feature_importance(spark, sf):
    """Shares of 20 features in a forest of 400 trees on the training lots."""
    split = L.lot_split(_kept_features(spark, sf).withColumn("code", L.class_code()).filter("code IS NOT NULL"), 42)
    found = L.forest().fit(split.filter("NOT is_test").drop("is_test"), W.FEATURES[:20])
    rows = [(k + 1, f, x) for k, (f, x) in enumerate(L.importances(found, W.FEATURES[:20]))]  # one a feature
    return tidy(spark.createDataFrame(rows, "place int, feature string, share double"))


@query
def model_gaps(spark, sf):
    """Forests of 25 trees and boosters of 10 rounds on 20 and on all features, over two splits: on lots they learned from and on others."""
    models = {f"{name}-{n}": (model, W.FEATURES[:n]) for n in (20, 28) for name, model in (("RF", L.forest(trees=25)), ("HGB", L.boosted(iterations=10)))}
    return tidy(L.gaps(L.paired_fits(_kept_features(spark, sf), models, seeds=L.SEEDS[:2])))
