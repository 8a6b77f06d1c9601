"""Forests and boosting from summed histograms against dense forms that hold all rows in one array."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltrace.operators import trees as R


def table(spark, n=260, classes=3, seed=1, width=5):
    rng = np.random.default_rng(seed)
    code = rng.integers(0, classes, n)
    code[code == 1] = np.where(rng.random((code == 1).sum()) < 0.7, 0, 1)  # an uneven share
    x = rng.normal(size=(n, width)).round(1)
    x[:, 0] += code
    x[:, 1] += (code == 1) * (x[:, 2] > 0)
    x[:, -1] = 0.5  # cannot be split
    names = [f"f{k}" for k in range(width)]
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(code, x, strict=True))]
    df = spark.createDataFrame(rows, "id long, code int, " + ", ".join(f"{c} double" for c in names)).repartition(4)
    return df, names, code, x


def prepared(df, names):
    bounds = R.cuts(df, names)
    rows = R.binned(df, names, bounds, F.xxhash64("id"))
    held = sorted((r.row, r.code, r.bins) for r in rows.collect())
    row = np.array([r for r, _, _ in held], np.int64).view(np.uint64)
    return bounds, rows, row, np.array([c for _, c, _ in held]), np.array([list(b) for _, _, b in held], np.uint8)


def side(c, w):
    w = c * w
    return (w * w).sum() / w.sum() if w.sum() else 0.0


def dense_tree(bins, code, n, weight, classes, seed, tries, least):
    """Nested (feature, cut, left, right) or class shares of one tree; n: how often each row was drawn."""

    def counts(rows):
        return np.bincount(code[rows], n[rows], classes)

    def grow(rows, seed):
        c = counts(rows)
        leaf = c * weight / (c * weight).sum()
        if len(rows) < 2 * least or (c > 0).sum() < 2:
            return leaf
        order = np.argsort(R.mixed(np.array(seed) ^ np.arange(1, bins.shape[1] + 1, dtype=np.uint64)))
        for turn in range(0, bins.shape[1], tries):
            best = None
            for f in order[turn : turn + tries]:
                for b in np.unique(bins[rows, f]):
                    left = rows[bins[rows, f] <= b]
                    if least <= len(left) <= len(rows) - least:
                        gain = round(side(counts(left), weight) + side(c - counts(left), weight) - side(c, weight), 9)
                        if best is None or gain > best[0]:
                            best = (gain, f, b)
            if best:
                _, f, b = best
                go = bins[rows, f] <= b
                seeds = R.mixed(np.array([seed, seed], np.uint64) * np.uint64(2) + np.array([1, 2], np.uint64))
                return (f, b, grow(rows[go], seeds[0]), grow(rows[~go], seeds[1]))
        return leaf

    return grow(np.flatnonzero(n), seed)


def at(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("open_nodes", [1 << 15, 7])
def test_forest_equals_dense_trees(spark, open_nodes):
    df, names, _, _ = table(spark)
    bounds, rows, row, code, bins = prepared(df, names)
    trees, classes = 9, 3
    forest = R.fit_forest(rows, bounds, classes, trees=trees, seed=5, open_nodes=open_nodes)
    n = R.drawn(row, np.arange(trees), 5)
    weights = R.class_weights(rows, trees, classes, 5)
    seeds = R.mixed(np.arange(trees, dtype=np.uint64) + np.uint64(5) * np.uint64(0x9E3779B9))
    with np.errstate(over="ignore"):
        own = [dense_tree(bins, code, n[:, t], weights[t], classes, seeds[t], 2, 2) for t in range(trees)]
    want = np.array([np.mean([at(t, b) for t in own], axis=0) for b in bins])
    assert np.abs(forest.probabilities(bins) - want).max() < 1e-9

    def gains(t, rows, n, weight, out):
        if isinstance(t, tuple):
            go = bins[rows, t[0]] <= t[1]
            c = [np.bincount(code[r], n[r], classes) for r in (rows, rows[go], rows[~go])]
            out[t[0]] += side(c[1], weight) + side(c[2], weight) - side(c[0], weight)
            gains(t[2], rows[go], n, weight, out)
            gains(t[3], rows[~go], n, weight, out)
        return out

    shares = [gains(t, np.flatnonzero(n[:, k]), n[:, k], weights[k], np.zeros(5)) for k, t in enumerate(own)]
    assert forest.importance == pytest.approx(np.mean([x / x.sum() for x in shares], axis=0), abs=1e-7)
    assert forest.importance.argmax() == 0 and forest.importance[-1] == 0

    def depth(t):
        return 1 + max(depth(t[2]), depth(t[3])) if isinstance(t, tuple) else 0

    assert max(depth(t) for t in own) > 8  # no bound on depth


def test_class_weights_are_those_of_each_sample(spark):
    df, names, _, _ = table(spark, 300)
    _, rows, row, code, _ = prepared(df.unionByName(df.limit(1).withColumn("code", F.lit(7)).withColumn("id", F.lit(-1).cast("long"))), names)
    n = R.drawn(row, np.arange(20), 3)
    got = R.class_weights(rows, 20, 9, 3)
    for t in range(20):
        c = np.bincount(code, n[:, t], 9)
        want = np.where(c > 0, c.sum() / ((c > 0).sum() * np.maximum(c, 1)), 0.0)
        assert got[t] == pytest.approx(want)
    assert 0.9 < n.mean() < 1.1 and abs((n == 0).mean() - np.exp(-1)) < 0.03
    assert len({tuple(x) for x in n.T.tolist()}) == 20  # a sample of its own for each tree


def dense_booster(bins, code, classes, iterations, rate, leaves, least, l2):
    n = np.bincount(code, minlength=classes)
    weight = np.where(n > 0, n.sum() / ((n > 0).sum() * np.maximum(n, 1)), 0.0)
    prior = np.log(np.maximum(n * weight / (n * weight).sum(), 1e-12))
    scores = np.tile(prior, (len(code), 1))
    for _ in range(iterations):
        gh = R.gradients(scores, code, weight) / R.FIXED
        for k in range(classes):
            g, h = gh[:, k, 0], gh[:, k, 1]
            value = lambda r, g=g, h=h: g[r].sum() ** 2 / (h[r].sum() + l2)

            def split(r, value=value):
                found = (0.0, None)
                for f in range(bins.shape[1]):
                    for b in np.unique(bins[r, f]):
                        left = r[bins[r, f] <= b]
                        right = r[bins[r, f] > b]
                        if len(left) >= least and len(right) >= least:
                            gain = round(value(left) + value(right) - value(r), 9)
                            if gain > found[0]:
                                found = (gain, (left, right))
                return found

            edge = [(np.arange(len(code)), split(np.arange(len(code))))]
            while len(edge) < leaves and max(x[1][0] for x in edge) > 0:
                k0 = max(range(len(edge)), key=lambda i: edge[i][1][0])
                _, (_, (left, right)) = edge.pop(k0)
                edge += [(left, split(left)), (right, split(right))]
            for r, _ in edge:
                scores[r, k] -= rate * g[r].sum() / (h[r].sum() + l2)
    return R.softmax(scores)


def test_booster_equals_dense_form(spark):
    df, names, _, _ = table(spark, 220)
    bounds, rows, _, code, bins = prepared(df, names)
    model = R.fit_booster(rows, bounds, 3, iterations=5, rate=0.3, leaves=7, min_leaf=10, l2=0.5, keep=2)
    want = dense_booster(bins, code, 3, 5, 0.3, 7, 10, 0.5)
    assert np.abs(model.probabilities(bins) - want).max() < 1e-6
    assert (model.probabilities(bins).argmax(1) == code).mean() > 0.75
    sizes = [(model.trees.feature[:] == R.LEAF).sum()]
    assert sizes[0] <= 5 * 3 * 7 * 2


def test_best_first_looks_only_where_it_may_split():
    gains, children = {0: 5.0}, {}
    assert R.best_first(gains, children, 0, 4) == ([0], [0])
    children[0] = 1
    gains |= {1: 1.0, 2: 3.0}
    assert R.best_first(gains, children, 0, 3) == ([0, 2], [2])
    assert R.best_first(gains, children, 0, 4) == ([0, 2, 1], [2, 1])
    assert R.best_first({}, {}, 0, 31) == ([], [])


def test_probabilities_as_a_column_and_odd_rows(spark):
    df, names, code, _ = table(spark, 150)
    odd = df.unionByName(df.limit(2).withColumn("f0", F.lit(None).cast("double"))).unionByName(df.limit(3).withColumn("code", F.lit(None).cast("int")))
    bounds = R.cuts(odd, names)
    assert len(bounds[-1]) == 1 and len(bounds[0]) <= R.BINS - 1
    rows = R.binned(odd, names, bounds, F.xxhash64("id", "f0"))
    assert rows.count() == 152  # rows without a class are not learned from
    forest = R.fit_forest(rows, bounds, 3, trees=12)
    out = R.with_probabilities(odd, names, forest).collect()
    assert len(out) == 155 and all(abs(sum(r.probability) - 1) < 1e-9 and min(r.probability) >= 0 for r in out)
    one = R.fit_forest(rows.filter("code = 0"), bounds, 3, trees=3)
    assert {tuple(r.probability) for r in R.with_probabilities(df, names, one).collect()} == {(1.0, 0.0, 0.0)}


def test_model_does_not_depend_on_partitions(spark):
    df, names, _, _ = table(spark, 200)
    bounds, rows, _, _, bins = prepared(df, names)
    a, b = (R.fit_forest(rows.repartition(p), bounds, 3, trees=5).probabilities(bins) for p in (1, 7))
    assert (a == b).all()


def test_nodes_of_few_rows_are_grown_by_one_task(spark, monkeypatch):
    df, names, _, _ = table(spark)
    bounds, rows, _, _, bins = prepared(df, names)
    steps, step = [], R._step
    monkeypatch.setattr(R, "_step", lambda *a: steps.append(0) or step(*a))
    whole = R.fit_forest(rows, bounds, 3, trees=9, seed=5)
    assert not steps  # all trees in one job, however deep
    apart = {}
    for node_bytes in (0, 200):  # no node, nodes of up to 40 rows
        steps.clear()
        apart[node_bytes] = R.fit_forest(rows, bounds, 3, trees=9, seed=5, node_bytes=node_bytes), len(steps)
    assert apart[0][1] > apart[200][1] > 0
    for forest, _ in apart.values():
        assert (forest.probabilities(bins) == whole.probabilities(bins)).all()
        assert len(forest.trees.feature) == len(whole.trees.feature) and (forest.trees.feature != R.OPEN).all()
        assert forest.importance == pytest.approx(whole.importance, abs=1e-12)


def test_a_task_grows_many_nodes_in_turn(spark, monkeypatch):
    df, names, _, _ = table(spark, 200)
    bounds, rows, _, _, bins = prepared(df, names)
    want = R.fit_forest(rows, bounds, 3, trees=7)
    monkeypatch.setattr(R, "CELLS_AT_ONCE", 300)  # a node or two at a time
    monkeypatch.setattr(R, "GROUP_BYTES", 2000)  # more groups than tasks
    got = R.fit_forest(rows, bounds, 3, trees=7)
    assert (got.probabilities(bins) == want.probabilities(bins)).all()
    assert got.importance == pytest.approx(want.importance, abs=1e-12)
    assert R.fit_forest(rows.limit(0), bounds, 3, trees=2).probabilities(bins).shape == bins[:, :3].shape


def test_cuts_of_many_sets_are_those_of_each(spark):
    df, names, _, _ = table(spark, 120)
    sets = df.withColumn("k", (F.col("id") % 3).cast("int"))
    got = R.cuts_by(sets, names, "k")
    assert sorted(got) == [0, 1, 2]
    for k, own in got.items():
        for a, b in zip(own, R.cuts(sets.filter(F.col("k") == k), names), strict=True):
            assert a.tolist() == b.tolist()
