"""Classification and detection metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.functions.columns import ratio
from siltrace.operators.ranks import cumulated, quantiles, quantiles_by
from siltrace.sources.dimensions import CLASSES, CLASSES9, class_table
from siltrace.sources.stored import written


def confusion(df: DataFrame, labels: Sequence[str] = CLASSES9, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(truth, pred, n) for every pair of labels, absent ones with 0."""
    names = class_table(df.sparkSession, tuple(labels)).select("name")
    pairs = names.select(F.col("name").alias("truth")).crossJoin(F.broadcast(names.select(F.col("name").alias("pred"))))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return pairs.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, labels: Sequence[str] = CLASSES, truth: str = "y_true", pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """(by..., name, support, precision, recall, f1) of each label; 0 where undefined."""
    one = F.explode(F.array(*[F.lit(c) for c in labels])).alias("name")
    rows = df.select(*by, F.col(truth).alias("t"), F.col(pred).alias("p"), one)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hit = F.count_if((F.col("t") == F.col("name")) & (F.col("p") == F.col("name")))
    support, named = F.count_if(F.col("t") == F.col("name")), F.count_if(F.col("p") == F.col("name"))
    return rows.groupBy(*by, "name").agg(
        support.alias("support"),
        zero(ratio(hit, named)).alias("precision"),
        zero(ratio(hit, support)).alias("recall"),
        zero(ratio(2 * hit, support + named)).alias("f1"),
    )


def macro_f1(df: DataFrame, labels: Sequence[str] = CLASSES, only_present: bool = False, by: Sequence[str] = (), **columns: str) -> DataFrame:
    """(by..., macro_f1, balanced_accuracy): over fixed labels, or only those present in the truth; recall over present labels."""
    report = class_report(df, labels, by=by, **columns)
    present = F.col("support") > 0
    f1 = F.when(present, F.col("f1")) if only_present else F.col("f1")
    return report.groupBy(*by).agg(F.avg(f1).alias("macro_f1"), F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"))


def class_medians(df: DataFrame, features: Sequence[str], truth: str = "y_true", pred: str | None = "y_pred") -> DataFrame:
    """Median of each feature, number and recall of each class; rows without a class are a class.

    Medians of all features and classes come from one table of counted values (:func:`siltrace.operators.ranks.quantiles_by`)."""
    keyed = written(df.withColumn("_class", F.coalesce(F.concat(F.lit("="), F.col(truth).cast("string")), F.lit(""))), "classes")
    recall = [F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("recall")] if pred else []
    counts = keyed.groupBy("_class", F.col(truth).alias("name")).agg(F.count("*").alias("n"), *recall)
    medians = quantiles_by(unpivoted(keyed, features, "_class"), ("_class", "feature"), "value", (0.5,))
    wide = medians.groupBy("_class").agg(*[F.max(F.when(F.col("feature") == f, F.col("quantile"))).alias(f) for f in features])
    return counts.join(wide, "_class", "left").drop("_class")


def unpivoted(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """(keep..., feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(pairs))


def auc_table(df: DataFrame, features: Sequence[str], labels: Sequence[str] = CLASSES, truth: str = "y_true") -> DataFrame:
    """(name, feature, auc): one-vs-rest rank AUC of each class and feature; 0.5 where a side is empty.  Rows without a class take no part.

    Values are counted by (feature, value, class) first; ranks come from cumulative counts over distinct values, so that no
    task holds more than a feature's distinct values.
    """
    counts = unpivoted(df.filter(F.col(truth).isNotNull()), features, truth).groupBy("feature", "value", truth).agg(F.count("*").alias("n"))
    by_value = counts.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(truth, "n"))).alias("of"))
    ranked = cumulated(by_value, [F.col("value")], {"below": F.col("n")}, by=["feature"]).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0)
    names = F.explode(F.array(*[F.lit(c) for c in labels])).alias("name")
    own = F.coalesce(F.try_element_at("of", F.col("name")), F.lit(0))
    sums = ranked.select("feature", "n", "rank", "of", names).groupBy("name", "feature").agg(
        F.sum(own * F.col("rank")).alias("r"), F.sum(own).cast("double").alias("n1"), F.sum(F.col("n") - own).cast("double").alias("n0")
    )
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select("name", "feature", F.coalesce(F.try_divide(u, F.col("n1") * F.col("n0")), F.lit(0.5)).alias("auc"))


def pairwise_auc(df: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]], truth: str = "y_true") -> DataFrame:
    """(name, other, feature, auc): rank AUC of one class against one other; 0.5 where either is empty."""
    names = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("other")) for a, b in pairs])).alias("pair")
    rows = df.filter(F.col(truth).isin(sorted({c for p in pairs for c in p}))).select(truth, *features, names)
    rows = rows.filter((F.col(truth) == F.col("pair.name")) | (F.col(truth) == F.col("pair.other")))
    hit = F.col(truth) == F.col("pair.name")
    counts = unpivoted(rows.withColumns({"name": F.col("pair.name"), "other": F.col("pair.other"), "hit": hit}), features, "name", "other", "hit")
    by_value = counts.groupBy("name", "other", "feature", "value").agg(F.count_if("hit").alias("n1"), F.count_if(~F.col("hit")).alias("n0"))
    placed = cumulated(by_value, [F.col("value")], {"below": F.col("n0")}, by=["name", "other", "feature"])
    sums = placed.groupBy("name", "other", "feature").agg(
        F.sum(F.col("n1") * (F.col("below") + F.col("n0") / 2.0)).alias("u"), F.sum("n1").cast("double").alias("n1"), F.sum("n0").cast("double").alias("n0")
    )
    return sums.select("name", "other", "feature", F.coalesce(F.try_divide(F.col("u"), F.col("n1") * F.col("n0")), F.lit(0.5)).alias("auc"))


def auc_ranking(auc: DataFrame, top: int = 10) -> DataFrame:
    """The features farthest from 0.5, ties by name."""
    return auc.withColumn("gap", F.round(F.abs(F.col("auc") - 0.5), 9)).orderBy(F.desc("gap"), "name", "feature").limit(top)


# --- detection: scores p and the flag is_defect ---


def _roc(scores: DataFrame, p: str = "p", defect: str = "is_defect") -> DataFrame:
    """(threshold, d, n, tp, fp, tpr, fpr, tpr0, fpr0) at every distinct score; the last two are those of the next higher score."""
    by = scores.groupBy(F.col(p).alias("threshold")).agg(F.count_if(F.col(defect)).alias("d"), F.count_if(~F.col(defect)).alias("n"))
    above = cumulated(by, [F.desc("threshold")], {"tp0": F.col("d"), "fp0": F.col("n")})
    sums = by.agg(F.sum("d").alias("all_d"), F.sum("n").alias("all_n"))
    both = above.withColumns({"tp": F.col("tp0") + F.col("d"), "fp": F.col("fp0") + F.col("n")}).crossJoin(F.broadcast(sums))
    shares = {f"{k}r{x}": ratio(F.col(f"{k}p{x}"), F.col(total)) for k, total in (("t", "all_d"), ("f", "all_n")) for x in ("", "0")}
    return both.select("threshold", "d", "n", "tp", "fp", shares["tr"].alias("tpr"), shares["fr"].alias("fpr"), shares["tr0"].alias("tpr0"), shares["fr0"].alias("fpr0"))


def roc_points(scores: DataFrame, p: str = "p", defect: str = "is_defect") -> DataFrame:
    """(threshold, tp, fp, tpr, fpr) at every distinct score."""
    return _roc(scores, p, defect).select("threshold", "tp", "fp", "tpr", "fpr")


def average_precision(scores: DataFrame, **columns: str) -> DataFrame:
    """(auc, average_precision): trapezoids of the ROC polyline, step sum of precision over recall."""
    return _roc(scores, **columns).agg(
        F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("auc"),
        F.sum((F.col("tpr") - F.col("tpr0")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"),
    )


FAR = (0.005, 0.01, 0.02, 0.05, 0.10)


def recall_at_far(scores: DataFrame, grid: Sequence[float] = FAR, **columns: str) -> DataFrame:
    """(far, recall) by linear interpolation on the ROC polyline, which starts at (0, 0)."""
    spark = scores.sparkSession
    points = roc_points(scores, **columns).select("fpr", "tpr").unionByName(spark.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))
    far = spark.createDataFrame([(float(f),) for f in grid], "far double")
    below = F.col("fpr") <= F.col("far")
    ends = points.crossJoin(F.broadcast(far)).groupBy("far").agg(
        F.max(F.when(below, F.struct("fpr", "tpr"))).alias("a"), F.min(F.when(~below, F.struct("fpr", "tpr"))).alias("b")
    )
    slope = F.try_divide(F.col("b.tpr") - F.col("a.tpr"), F.col("b.fpr") - F.col("a.fpr"))
    return ends.select("far", (F.col("a.tpr") + F.coalesce(slope * (F.col("far") - F.col("a.fpr")), F.lit(0.0))).alias("recall"))


def far_thresholds(scores: DataFrame, grid: Sequence[float] = FAR, p: str = "p", defect: str = "is_defect") -> DataFrame:
    """(far, threshold): the exact, linearly interpolated quantile of normal scores; 0.5 without normals."""
    cuts = quantiles(scores.filter(~F.col(defect)), p, [1.0 - f for f in grid])
    far = F.element_at(F.create_map(*[F.lit(float(x)) for f in grid for x in (1.0 - f, f)]), F.col("share"))
    return cuts.select(far.alias("far"), F.coalesce("quantile", F.lit(0.5)).alias("threshold"))


def end_to_end(df: DataFrame, truth: str = "y_true", pred: str = "y_cascade", none: str = "NONE") -> DataFrame:
    """(none_precision, none_recall, review_frac) of a cascade's verdicts; precision 0 where nothing is passed as ``none``."""
    same = ((F.col(truth) == none) & (F.col(pred) == none)).cast("double")
    return df.agg(
        F.coalesce(F.avg(F.when(F.col(pred) == none, same)), F.lit(0.0)).alias("none_precision"),
        F.avg(F.when(F.col(truth) == none, same)).alias("none_recall"),
        F.avg((F.col(pred) != none).cast("double")).alias("review_frac"),
    )


def operating_points(scores: DataFrame, grid: Sequence[float] = FAR, p: str = "p", defect: str = "is_defect") -> DataFrame:
    """(far, threshold, actual_far, recall, review): what strictly exceeds each threshold."""
    cuts = F.broadcast(far_thresholds(scores, grid, p, defect))
    flagged = (F.col(p) > F.col("threshold")).cast("double")
    return scores.crossJoin(cuts).groupBy("far", "threshold").agg(
        F.avg(F.when(~F.col(defect), flagged)).alias("actual_far"), F.avg(F.when(F.col(defect), flagged)).alias("recall"), F.avg(flagged).alias("review")
    )


def miss_table(df: DataFrame, flagged: str = "flagged", name: str = "y_true") -> DataFrame:
    """(name, total, missed, miss_rate) of each class."""
    missed = ~F.col(flagged)
    return df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("total"), F.count_if(missed).alias("missed"), F.avg(missed.cast("double")).alias("miss_rate"))


def cascade(df: DataFrame, threshold: float, p: str = "p", stage2: str = "y_pred") -> DataFrame:
    """Adds y_cascade: the second stage's class where the first flags, else NONE."""
    return df.withColumn("y_cascade", F.when(F.col(p) > threshold, F.col(stage2)).otherwise("NONE"))


def paired_models(results: DataFrame, baseline: str, digits: int = 9) -> DataFrame:
    """(model, mean, std, low, high, mean_gain, wins, n) over seeds of (model, seed, f1), against a baseline model."""
    base = results.filter(F.col("model") == baseline).select("seed", F.col("f1").alias("base"))
    gain = F.round(F.col("f1") - F.col("base"), digits)
    return results.join(base, "seed").groupBy("model").agg(
        F.avg("f1").alias("mean"), F.stddev_samp("f1").alias("std"), F.min("f1").alias("low"), F.max("f1").alias("high"),
        F.avg(gain).alias("mean_gain"), F.count_if(gain > 0).alias("wins"), F.count("*").alias("n"),
    )


def operating_curve(points: DataFrame) -> DataFrame:
    """(far, mean, low, high) recall over seeds, from (seed, far, recall)."""
    return points.groupBy("far").agg(F.avg("recall").alias("mean"), F.min("recall").alias("low"), F.max("recall").alias("high"))
