"""Splits, folds and fits of trees: single ones by Spark ML, forests and boosting by :mod:`siltrace.operators.trees`."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltrace.operators.metrics import macro_f1
from siltrace.operators.ranks import cumulated
from siltrace.operators.trees import Booster, Forest, binned, cuts, cuts_by, fit_booster, fit_forest, with_probabilities
from siltrace.sources.dimensions import CLASSES
from siltrace.sources.stored import dropped, written


def _digits(*parts: Column) -> Column:
    """A number below 2**32 from the md5 of its parts, which other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def lot_split(df: DataFrame, seed: int, test_frac: float = 0.3, lot: str = "lot") -> DataFrame:
    """Adds is_test: whole lots, ``test_frac`` of them rounded down, those whose md5 of seed and lot comes first."""
    place = _digits(F.lit(str(seed)), F.col(lot).cast("string"))
    lots = df.select(lot).distinct().withColumn("_place", place)
    total = lots.agg(F.count("*").alias("_lots"))
    ranked = cumulated(lots, [F.col("_place"), F.col(lot)], {"_rank": F.lit(1)}).crossJoin(F.broadcast(total))
    return df.join(ranked.select(lot, (F.col("_rank") < F.floor(F.col("_lots") * test_frac + 1e-9)).alias("is_test")), lot)


def fold_turns(sizes: Mapping[int, int], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, end, folds): the groups of a size, numbered from 0, that take these folds in turn.

    The greedy rule gives each group, from the largest to the smallest, to the lightest fold, the first of equals.  Among groups of one
    size a fold of load x is chosen at x, x + size, x + 2 * size ...: folds whose load holds ``size`` equally often take turns in order
    of what is left, until the next fold is as heavy as they are.  So a size has at most as many stretches as there are folds.
    """
    loads, out = [0] * folds, []
    for size in sorted(sizes, reverse=True):
        levels = sorted({x // size for x in loads})
        first, taken = 0, [0] * folds
        for level, after in zip(levels, [*levels[1:], None], strict=True):
            own = sorted((f for f in range(folds) if loads[f] // size <= level), key=lambda f: (loads[f] % size, f))
            count = sizes[size] - first
            count = count if after is None else min(count, (after - level) * len(own))
            if count:
                out.append((size, first, first + count, own))
                for k, f in enumerate(own):
                    taken[f] += count // len(own) + (k < count % len(own))
                first += count
        loads = [x + n * size for x, n in zip(loads, taken, strict=True)]
    return out


def group_folds(df: DataFrame, folds: int = 4, group: str = "lot") -> DataFrame:
    """Adds fold: whole groups, from the largest to the smallest (equal ones by name) each to the lightest fold, the first of equals.

    The rule is played on the number of groups of each size, of which there are at most sqrt(2 * rows); groups find their fold by
    their rank within their size."""
    sizes = written(df.groupBy(group).agg(F.count("*").alias("_n")), "group-sizes")
    counts = {r["_n"]: r["n"] for r in sizes.groupBy("_n").agg(F.count("*").alias("n")).collect()}
    turns = df.sparkSession.createDataFrame(fold_turns(counts, folds), "_n long, _first long, _end long, _folds array<int>")
    ranked = cumulated(sizes, [F.col(group)], {"_rank": F.lit(1)}, by=["_n"])
    met = ranked.join(F.broadcast(turns), "_n").filter("_first <= _rank AND _rank < _end")
    fold = F.element_at("_folds", ((F.col("_rank") - F.col("_first")) % F.size("_folds")).cast("int") + 1)
    return df.join(met.select(group, fold.alias("fold")), group)


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def class_code(label: str = "y_true", classes: Sequence[str] = CLASSES) -> Column:
    """Place of a label among the classes as a double; null for others."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    return F.when(place > 0, (place - 1).cast("double"))


def balanced(df: DataFrame, code: str = "code") -> DataFrame:
    """Adds weight: inversely proportional to the class's rows (classes are few: their counts are a broadcast table)."""
    counts = df.groupBy(code).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all")).crossJoin(counts.agg(F.count("*").alias("_k")))
    weights = counts.crossJoin(total).select(code, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), code)


@dataclass(frozen=True)
class Grown:
    """A model to grow from histograms; ``grow`` takes (rows, bounds, number of classes)."""

    grow: Callable[..., Forest | Booster]

    def fit(self, train: DataFrame, features: Sequence[str], classes: int = len(CLASSES), bounds: list[np.ndarray] | None = None) -> Forest | Booster:
        """The model of rows with a code; all their columns tell rows apart in bootstrap samples.  bounds: their ``cuts``, where known."""
        rows = train.drop("features")
        bounds = cuts(rows, features) if bounds is None else bounds
        return self.grow(binned(rows, features, bounds, F.xxhash64(*rows.columns)), bounds, classes)


def forest(trees: int = 400, min_leaf: int = 2, seed: int = 42) -> Grown:
    """Trees of any depth, each on a bootstrap sample of its own that weighs classes by their rows in it."""
    return Grown(lambda rows, bounds, classes: fit_forest(rows, bounds, classes, trees=trees, min_leaf=min_leaf, seed=seed))


def boosted(iterations: int = 400, rate: float = 0.06, leaves: int = 31, min_leaf: int = 10, l2: float = 0.5) -> Grown:
    """One multiclass booster with softmax loss."""
    return Grown(lambda rows, bounds, classes: fit_booster(rows, bounds, classes, iterations=iterations, rate=rate, leaves=leaves, min_leaf=min_leaf, l2=l2))


def tree(depth: int = 8, seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(labelCol="code", weightCol="weight", maxDepth=depth, seed=seed)


def fitted(model: Grown | DecisionTreeClassifier, train: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Fits rows with a code and returns what adds ``prediction``, the place of the class, to others."""
    if isinstance(model, Grown):
        found = model.fit(train, features)
        place = F.array_position("probability", F.array_max("probability")) - 1  # the first of equals
        return lambda df: with_probabilities(df, features, found).withColumn("prediction", place.cast("double"))
    own = model.fit(balanced(assembled(train.drop("features"), features)))
    return lambda df: own.transform(assembled(df.drop("features"), features)).drop("features", "rawPrediction")


def trained_predictions(df: DataFrame, features: Sequence[str], model: Grown | DecisionTreeClassifier, seed: int = 42, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Test rows with y_pred of a model fitted on the other lots."""
    rows = df.withColumn("code", class_code(classes=classes)).filter("code IS NOT NULL")
    split = written(lot_split(rows, seed), "split")
    return _split_predictions(split, features, model, classes)


def _split_predictions(split: DataFrame, features: Sequence[str], model: Grown | DecisionTreeClassifier, classes: Sequence[str] = CLASSES) -> DataFrame:
    judged = fitted(model, split.filter("NOT is_test"), features)
    return _named(judged(split.filter("is_test")), classes).drop("probability", "prediction")


def _named(scored: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn("y_pred", F.element_at(names, F.col("prediction").cast("int") + 1))


def _coded(df: DataFrame) -> DataFrame:
    return df.withColumn("code", class_code()).filter("code IS NOT NULL")


def fold_scores(df: DataFrame, features: Sequence[str], models: Mapping[float, object], folds: int = 4) -> dict[float, float]:
    """Mean macro-F1 of each model over group folds; rows of held-out groups are scored by models that never saw them."""
    rows = written(group_folds(_coded(df), folds), "folds")
    held = [(rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)) for k in range(folds)]
    held = [(a, b) for a, b in held if not a.isEmpty() and not b.isEmpty()]
    score = lambda m, a, b: macro_f1(_named(fitted(m, a, features)(b))).first()["macro_f1"]
    return {name: float(np.mean([score(m, a, b) for a, b in held])) if held else 0.0 for name, m in models.items()}


def _first_best(scores: Mapping[float, float]) -> float:
    return max(scores, key=lambda k: (round(scores[k], 9), -list(scores).index(k)))


DEPTHS, EXTENDED_DEPTHS = (3, 4, 5, 6, 8, 10), (4, 6, 8, 10, 12, 14)
LEAVES, SEEDS = (1, 2, 4, 8, 16), (42, 0, 1, 2, 3)


def tree_depth(df: DataFrame, features: Sequence[str], depths: Sequence[int] = DEPTHS, folds: int = 4) -> int:
    """The depth of best mean macro-F1 over group folds; the first of equals."""
    return _first_best(fold_scores(df, features, {d: tree(d) for d in depths}, folds))


def searched_tree(df: DataFrame, features: Sequence[str], seed: int = 42, depths: Sequence[int] = DEPTHS, folds: int = 4) -> DataFrame:
    """Test rows with y_pred of a tree whose depth was chosen on the training lots alone."""
    split = written(lot_split(df, seed), "split")
    depth = tree_depth(split.filter("NOT is_test").drop("is_test"), features, depths, folds)
    return trained_predictions(df, features, tree(depth, seed), seed)


def leaf_scan(df: DataFrame, features: Sequence[str], leaves: Sequence[int] = LEAVES, trees: int = 400, seed: int = 42, folds: int = 4) -> list[tuple]:
    """(leaf, inner, train, test, chosen) of forests by least rows in a leaf: macro-F1 over group folds of the training lots, on
    these and on the test lots.  The choice looks at the first alone, the first of equals."""
    split = written(lot_split(_coded(df), seed), "split")
    own, test = split.filter("NOT is_test").drop("is_test"), split.filter("is_test").drop("is_test")
    inner = fold_scores(own.drop("code"), features, {k: forest(trees, k, seed) for k in leaves}, folds)
    chosen, out = _first_best(inner), []
    for k in leaves:
        judged = fitted(forest(trees, k, seed), own, features)
        ends = [macro_f1(_named(judged(part))).first()["macro_f1"] for part in (own, test)]
        out.append((k, inner[k], *ends, k == chosen))
    return out


def paired_fits(df: DataFrame, models: Mapping[str, tuple[Grown | DecisionTreeClassifier, Sequence[str]]], seeds: Sequence[int] = SEEDS) -> DataFrame:
    """(model, seed, f1, train_f1) of each (model, features) on the test lots of each seed's split and on the lots it learned from, all
    models on the same splits."""
    rows = []  # two numbers for each model and seed
    for seed in seeds:
        split = written(lot_split(_coded(df), seed), "split")
        train, test = split.filter("NOT is_test"), split.filter("is_test")
        for name, (model, features) in models.items():
            judged = fitted(model, train, features)
            rows.append((name, seed, *[macro_f1(_named(judged(part))).first()["macro_f1"] for part in (test, train)]))
        dropped(split)
    return df.sparkSession.createDataFrame(rows, "model string, seed int, f1 double, train_f1 double")


def gaps(fits: DataFrame) -> DataFrame:
    """(model, train, test, gap): mean macro-F1 over seeds on the lots a model learned from and on others, and what lies between."""
    return fits.groupBy("model").agg(F.avg("train_f1").alias("train"), F.avg("f1").alias("test"), F.avg(F.col("train_f1") - F.col("f1")).alias("gap"))


def out_of_fold(df: DataFrame, features: Sequence[str], defect: str = "is_defect", folds: int = 4, group: str = "lot", trees: int = 200) -> DataFrame:
    """Adds p, the defect probability of a forest that never saw the row's group; 0 where it saw no defect."""
    rows = written(group_folds(df.withColumn("code", F.col(defect).cast("double")), folds, group), "folds")
    parts = []
    others = F.explode(F.array(*[F.lit(k) for k in range(folds)])).alias("_held")
    bounds = cuts_by(rows.select("fold", *features, others).filter("fold != _held"), features, "_held")
    for k in range(folds):
        train, held = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        kinds = {r["code"] for r in train.select("code").distinct().limit(3).collect()}
        if 1.0 not in kinds:
            parts.append(held.withColumn("p", F.lit(0.0)))
        else:
            found = forest(trees=trees).fit(train, features, 2, bounds.get(k))
            parts.append(with_probabilities(held, features, found).withColumn("p", F.get("probability", 1)).drop("probability"))
    return reduce(DataFrame.unionByName, parts)


def importances(model: Forest, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, share) from the most to the least important; equal ones by name."""
    return sorted(zip(features, model.importance.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def tree_text(df: DataFrame, features: Sequence[str], depth: int = 8, seed: int = 42) -> str:
    """The splits of a tree fitted on the training lots, with the features' names."""
    split = assembled(_coded(lot_split(df, seed)), features)
    text = tree(depth, seed).fit(balanced(split.filter("NOT is_test"))).toDebugString
    return re.sub(r"feature (\d+)", lambda m: features[int(m[1])], text)
