"""Detection end to end: is there a pattern at a chosen false-alarm rate, and which one?

Operating points come from scores of the training lots that no model gave to rows it had seen; they are then held against the test lots.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.operators import metrics as M
from siltrace.operators.ml import SEEDS, _coded, fitted, forest, lot_split, out_of_fold
from siltrace.operators.trees import with_probabilities
from siltrace.sources.dimensions import CLASSES
from siltrace.sources.stored import dropped, written

NONE = "NONE"


def detection_verdicts(
    df: DataFrame,
    first: Sequence[str],
    second: Sequence[str],
    *,
    keep: Sequence[str] = (),
    far: float = 0.02,
    grid: Sequence[float] = M.FAR,
    seeds: Sequence[int] = SEEDS,
    trees: tuple[int, int] = (200, 400),
    folds: int = 4,
    none: str = NONE,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, points) over each seed's split of rows (lot, y_true, features).

    verdicts, a row for each test row: (seed, keep..., lot, y_true, is_defect, p, threshold, flagged, y_pred, y_cascade).  p: of a first
    stage on the features ``first``; threshold: the one of out-of-fold scores of the training lots at the false-alarm rate ``far``; y_pred: of a
    second stage on the features ``second``, which learned from the defects of the training lots; y_cascade: y_pred where flagged.
    points: (seed, far, threshold, actual_far, recall) of each rate of ``grid`` on the test rows.  Rows whose y_true is neither a
    class nor ``none`` take no part.
    """
    rows = df.filter(F.col("y_true").isin(*CLASSES, none)).withColumn("is_defect", F.col("y_true") != none)
    own = ["lot", "y_true", "is_defect"]
    names = list(dict.fromkeys([*keep, *own, *first, *second]))
    verdicts, points = [], []
    for seed in seeds:
        split = written(lot_split(rows.select(names), seed), "split")
        train, test = split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")
        scores = written(out_of_fold(train, first, folds=folds, trees=trees[0]).select("p", "is_defect"), "out-of-fold")
        cuts = M.far_thresholds(scores, sorted({*grid, far}))
        cuts = written(cuts, "thresholds")
        detector = forest(trees[0]).fit(train.withColumn("code", F.col("is_defect").cast("double")), first, 2)
        judged = with_probabilities(test, first, detector).withColumn("p", F.get("probability", 1)).drop("probability")
        named = fitted(forest(trees[1]), _coded(train.filter("is_defect")), second)(judged)
        classes = F.array(*[F.lit(c) for c in CLASSES])
        named = named.withColumn("y_pred", F.element_at(classes, F.col("prediction").cast("int") + 1)).select(F.lit(seed).alias("seed"), *keep, *own, "p", "y_pred")
        named = written(named, "verdicts")
        chosen = cuts.filter(F.abs(F.col("far") - far) < 1e-12).select("threshold")  # one row
        flagged = named.crossJoin(F.broadcast(chosen)).withColumn("flagged", F.col("p") > F.col("threshold"))
        verdicts.append(flagged.withColumn("y_cascade", F.when(F.col("flagged"), F.col("y_pred")).otherwise(none)))
        over = (F.col("p") > F.col("threshold")).cast("double")
        met = named.crossJoin(F.broadcast(cuts)).groupBy("seed", "far", "threshold")
        points.append(met.agg(F.avg(F.when(~F.col("is_defect"), over)).alias("actual_far"), F.avg(F.when(F.col("is_defect"), over)).alias("recall")))
        for table in (split, scores):
            dropped(table)
    return reduce(DataFrame.unionByName, verdicts), reduce(DataFrame.unionByName, points)


def detection_summary(verdicts: DataFrame, none: str = NONE) -> DataFrame:
    """By seed: roc_auc, pr_auc, actual_far, recall, review_frac, none_precision, none_recall, e2e_macro_f1 and oracle_macro_f1, which
    supposes a perfect first stage."""
    flagged, true_none, said_none = F.col("flagged").cast("double"), F.col("y_true") == none, F.col("y_cascade") == none
    rates = verdicts.groupBy("seed").agg(
        F.avg(F.when(~F.col("is_defect"), flagged)).alias("actual_far"),
        F.avg(F.when(F.col("is_defect"), flagged)).alias("recall"),
        F.avg(flagged).alias("review_frac"),
        F.coalesce(F.avg(F.when(said_none, true_none.cast("double"))), F.lit(0.0)).alias("none_precision"),
        F.avg(F.when(true_none, said_none.cast("double"))).alias("none_recall"),
    )
    whole = M.macro_f1(verdicts, pred="y_cascade", by=("seed",)).select("seed", F.col("macro_f1").alias("e2e_macro_f1"))
    perfect = M.macro_f1(verdicts.filter("is_defect"), by=("seed",)).select("seed", F.col("macro_f1").alias("oracle_macro_f1"))
    seeds = [r["seed"] for r in verdicts.select("seed").distinct().collect()]
    curves = [M.average_precision(verdicts.filter(F.col("seed") == s)).select(F.lit(s).alias("seed"), F.col("auc").alias("roc_auc"), F.col("average_precision").alias("pr_auc")) for s in seeds]
    out = rates.join(whole, "seed", "left").join(perfect, "seed", "left")
    return out.join(reduce(DataFrame.unionByName, curves), "seed", "left") if curves else out


def missed_by_class(verdicts: DataFrame) -> DataFrame:
    """(name, total, missed, miss_rate) of defects over all seeds."""
    return M.miss_table(verdicts.filter("is_defect"))
