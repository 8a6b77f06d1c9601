"""Forests and boosted trees grown from histograms that Spark sums.

Values are binned once by exact quantiles.  To grow trees by one step, every task sends its rows down the trees as they are and counts, for
each open node, feature and bin, whole numbers: rows by class (forests), or gradients and hessians of fixed point (boosting).  Spark adds
them up; the tasks that hold a node's sums find its best split.  One row a node comes to the driver, which extends the trees.
A forest's nodes of few rows are dealt out with these rows: one task grows all that is below a node, by the same rule.

Sums of whole numbers do not depend on the order of tasks, so that a model is the same on any cluster and after lost executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltrace.operators.metrics import unpivoted
from siltrace.operators.ranks import quantiles_by
from siltrace.sources.stored import dropped, written

BINS = 255
OPEN_NODES = 1 << 15  # whose histograms one step sums
ROWS_AT_ONCE = 2048  # that a task sends down all trees together
NODE_BYTES = 1 << 22  # of the bins of a node's rows, up to which one task grows all below it
GROUP_BYTES = 1 << 26  # of the rows of all nodes that one task grows, one node after the other
CELLS_AT_ONCE = 1 << 20  # rows times features that a task sorts together
FIXED = float(1 << 30)  # a gradient of 1
LEAF, OPEN = -1, -2


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on those of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the distinct values that bound its bins: exact quantiles; a value up to the first lies in bin 0."""
    return cuts_by(df.withColumn("_set", F.lit(0)), features, "_set", bins).get(0, [np.zeros(0)] * len(features))


def cuts_by(df: DataFrame, features: Sequence[str], key: str, bins: int = BINS) -> dict[object, list[np.ndarray]]:
    """:func:`cuts` of the rows of each key, such as the rows that each fold learns from, in common passes."""
    found = quantiles_by(unpivoted(df, features, key), (key, "feature"), "value", [k / bins for k in range(1, bins)])
    rows = found.groupBy(key, "feature").agg(F.array_sort(F.collect_set("quantile")).alias("cuts")).collect()  # at most bins - 1 each
    by = {(r[key], r["feature"]): np.array(r["cuts"]) for r in rows}
    return {k: [by.get((k, f), np.zeros(0)) for f in features] for k in {k for k, _ in by}}


def bin_of(values: np.ndarray, bounds: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows of values; missing ones lie in the last."""
    return np.stack([np.searchsorted(b, values[:, k], "left") for k, b in enumerate(bounds)], 1).astype(np.uint8)


@dataclass
class Trees:
    """Nodes of many trees in common arrays: feature (LEAF, OPEN), cut (bins up to it go left), children, and rows of values."""

    roots: np.ndarray
    bounds: list[np.ndarray]
    values: np.ndarray  # nodes x outputs
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def planted(cls, n: int, bounds: list[np.ndarray], outputs: int) -> Trees:
        return cls(np.arange(n), bounds, np.zeros((n, outputs)), np.full(n, OPEN, np.int16), np.zeros(n, np.int16), np.zeros(n, np.int64))

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Gives nodes two open children each; the left ones (the right ones follow them)."""
        left = len(self.feature) + 2 * np.arange(len(nodes))
        self.feature[nodes], self.cut[nodes], self.left[nodes] = feature, cut, left
        more = 2 * len(nodes)
        self.feature = np.concatenate((self.feature, np.full(more, OPEN, np.int16)))
        self.cut, self.left = np.concatenate((self.cut, np.zeros(more, np.int16))), np.concatenate((self.left, np.zeros(more, np.int64)))
        self.values = np.concatenate((self.values, np.zeros((more, self.values.shape[1]))))
        return left

    def paths(self) -> Trees:
        """The trees without values and bounds: enough to send rows down them."""
        return Trees(self.roots, [], np.zeros((0, 0)), self.feature, self.cut, self.left)

    def leaves(self, bins: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaf or open node that each of the given rows reaches from ``node``."""
        node = node.copy()
        moving = np.flatnonzero(self.feature[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = self.left[at] + (bins[row[moving], self.feature[at]] > self.cut[at])
            moving = moving[self.feature[node[moving]] >= 0]
        return node

    def outputs(self, bins: np.ndarray) -> np.ndarray:
        """Sums of the trees' values, by row."""
        out = np.zeros((len(bins), self.values.shape[1]))
        rows = np.arange(len(bins))
        for root in self.roots:
            out += self.values[self.leaves(bins, rows, np.full(len(bins), root))]
        return out


def binned(df: DataFrame, features: Sequence[str], bounds: Sequence[np.ndarray], row: Column) -> DataFrame:
    """(row, code, bins): a written table of rows with a class; row: a 64-bit hash of what identifies a row."""
    values = F.array(*[F.col(f).cast("double") for f in features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            own = bin_of(flat.reshape(-1, len(bounds)), bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in own], pa.binary())], ["row", "code", "bins"])

    rows = df.select(row.cast("long").alias("row"), F.col("code").cast("int").alias("code"), values.alias("values")).filter("code IS NOT NULL")
    return written(rows.mapInArrow(run, "row long, code int, bins binary"), "binned")


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    row, code = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
    for a in range(0, len(row), ROWS_AT_ONCE):
        yield row[a : a + ROWS_AT_ONCE], code[a : a + ROWS_AT_ONCE], bins[a : a + ROWS_AT_ONCE]


def _summed(slot: np.ndarray, bins: np.ndarray, amounts: np.ndarray) -> pa.RecordBatch:
    """Amounts (n x columns of whole numbers) added up by slot and bin."""
    key = slot * np.int64(256) + bins
    order = np.argsort(key, kind="stable")
    key, amounts = key[order], amounts[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(amounts, first, axis=0) if len(first) else amounts[:0]
    names = ["slot", "bin", *[f"c{k}" for k in range(amounts.shape[1])]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[first] // 256, key[first] % 256, *sums.T)], names)


Gain = Callable[[np.ndarray, np.ndarray], np.ndarray]  # of the sums of a side and its node


def best_splits(slot: np.ndarray, bins: np.ndarray, sums: np.ndarray, slots: int, score: Gain, least: int) -> tuple[np.ndarray, ...]:
    """Of complete nodes' sums in order of slot and bin: (node, slot within it, bin, gain, sums left, sums of the node).

    ``slots`` of a node follow each other; the last column of ``sums`` is the number of rows, of which both sides keep
    ``least``.  score(sums of a side, node) is larger the purer the side is.  Without a split, the slot is -1.  Equal gains: the first slot and bin.
    """
    node = slot // slots
    new = np.concatenate(([True], slot[1:] != slot[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(slot)))
    run = np.cumsum(sums, axis=0)
    left = run - np.repeat(run[start] - sums[start], size, axis=0)
    whole = left[start + size - 1]
    total = np.repeat(whole, size, axis=0)
    able = np.flatnonzero((left[:, -1] >= least) & (total[:, -1] - left[:, -1] >= least))
    one, at = left[able], node[able]
    gain = np.full(len(slot), -np.inf)
    gain[able] = np.round(score(one, at) + score(total[able] - one, at) - np.repeat(score(whole, node[start]), size)[able], 9)
    head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    most = np.maximum.reduceat(gain, head)
    reach = np.diff(np.append(head, len(node)))
    hit = np.flatnonzero(gain == np.repeat(most, reach))
    best = hit[np.searchsorted(hit, head)]
    found = np.isfinite(most)
    return node[head], np.where(found, slot[best] % slots, -1), bins[best], most, left[best], total[head]


def _decided(slots: int, score: Gain, least: int) -> Callable:
    """From rows sorted by slot and bin to a row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None

        def decided(rows: np.ndarray) -> pa.RecordBatch:
            node, slot, cut, gain, left, total = best_splits(rows[:, 0], rows[:, 1], rows[:, 2:], slots, score, least)
            cut_at = pa.array(np.arange(len(node) + 1, dtype=np.int32) * left.shape[1])
            lists = [pa.ListArray.from_arrays(cut_at, pa.array(x.ravel())) for x in (left, total)]
            return pa.RecordBatch.from_arrays([*[pa.array(x) for x in (node, slot, cut, gain)], *lists], ["node", "slot", "cut", "gain", "left", "total"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            held = rows if held is None else np.concatenate((held, rows))
            last = np.searchsorted(held[:, 0], held[-1, 0] // slots * slots) if len(held) else 0
            if last:
                yield decided(held[:last])
                held = held[last:]
        if held is not None and len(held):
            yield decided(held)

    return run


def _step(rows: DataFrame, count: Callable, columns: int, slots: int, score: Gain, least: int) -> dict[str, np.ndarray]:
    """One row for each open node that has rows: the decisions of :func:`best_splits`."""
    names = [f"c{k}" for k in range(columns)]
    sums = rows.mapInArrow(count, "slot long, bin long, " + ", ".join(f"{c} long" for c in names))
    whole = sums.groupBy("slot", "bin").agg(*[F.sum(c).alias(c) for c in names])
    dealt = whole.repartition(F.floor(F.col("slot") / slots)).sortWithinPartitions("slot", "bin")
    out = dealt.mapInArrow(_decided(slots, score, least), "node long, slot long, cut long, gain double, left array<long>, total array<long>").toArrow()
    lists = {c: out[c].combine_chunks().flatten().to_numpy().reshape(-1, columns) for c in ("left", "total")}
    return {c: out[c].to_numpy() for c in ("node", "slot", "cut", "gain")} | lists


# --- forests ---

_POISSON = np.cumsum([np.exp(-1.0) / np.prod(range(1, k + 1), initial=1.0) for k in range(12)])


def drawn(row: np.ndarray, tree: np.ndarray, seed: int) -> np.ndarray:
    """How often each row stands in the bootstrap sample of each tree: Poisson numbers of mean 1, by hash (rows x trees)."""
    salt = mixed(tree.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return np.searchsorted(_POISSON, mixed(row[:, None] ^ salt[None, :]) / 2.0**64, "right")


def class_weights(rows: DataFrame, trees: int, classes: int, seed: int) -> np.ndarray:
    """trees x classes: inversely proportional to the class's rows in the tree's own sample, of classes that the sample has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            sums = np.zeros((trees, classes), np.int64)
            for a in range(0, len(row), ROWS_AT_ONCE):
                n = drawn(row[a : a + ROWS_AT_ONCE], np.arange(trees), seed)
                for k in np.unique(code[a : a + ROWS_AT_ONCE]):
                    sums[:, k] += n[code[a : a + ROWS_AT_ONCE] == k].sum(0)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], ["at", "n"])

    found = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most trees * classes
    n = np.zeros(trees * classes)
    n[found["at"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(trees, classes)
    kinds = (n > 0).sum(1, keepdims=True)
    return np.divide(n.sum(1, keepdims=True), kinds * n, out=np.zeros_like(n), where=n > 0)


def _purity(weights: np.ndarray) -> Gain:
    """What Gini impurity leaves of a side, whose classes are weighted by the row of ``weights`` of its node."""

    def score(sums: np.ndarray, node: np.ndarray) -> np.ndarray:
        squares, whole = np.zeros(len(sums)), np.zeros(len(sums))
        for c in range(weights.shape[1]):
            w = sums[:, c] * weights[node, c]
            squares += w * w
            whole += w
        return np.divide(squares, whole, out=np.zeros(len(sums)), where=sums[:, -1] > 0)

    return score


def _tried(seeds: np.ndarray, turn: np.ndarray, tries: int, width: int) -> np.ndarray:
    """nodes x tries: the features that nodes try in their turn; -1 where there are no more."""
    order = np.argsort(mixed(seeds[:, None] ^ np.arange(1, width + 1, dtype=np.uint64)[None, :]), axis=1)
    at = turn[:, None] * tries + np.arange(tries)[None, :]
    return np.where(at < width, np.take_along_axis(order, np.minimum(at, width - 1), 1), -1)


def _below(seeds: np.ndarray) -> np.ndarray:
    """Seeds of the two children of each node, side by side."""
    return mixed(np.repeat(seeds, 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(seeds)))


def _shares(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    share = counts * weights
    return share / np.maximum(share.sum(1, keepdims=True), 1e-300)


def grown(
    bins: np.ndarray, code: np.ndarray, row: np.ndarray, draws: np.ndarray, node: np.ndarray, seeds: np.ndarray, weights: np.ndarray, tries: int, least: int
) -> tuple[Trees, np.ndarray]:
    """All that is below some nodes, and what their splits by feature take from impurity (nodes x features).

    bins, code: of rows; row, draws, node: which row stands how often in the sample of which node; seeds, weights: by node.  The
    nodes are the first of the returned trees."""
    (nodes, classes), width = weights.shape, bins.shape[1]
    trees, taken = Trees.planted(nodes, [], classes), np.zeros((nodes, width))
    flat, row = bins.ravel(), row.astype(np.int64)
    top, low = np.arange(nodes), code[row].astype(np.int64) * 16 + draws  # a row is drawn 12 times at most
    bits = 4 + int(classes - 1).bit_length()
    counts = np.bincount(node * classes + code[row], draws, nodes * classes).reshape(-1, classes)
    trees.values[:] = _shares(counts, weights)
    done = (np.bincount(node, minlength=nodes) < 2 * least) | ((counts > 0).sum(1) < 2)
    trees.feature[done] = LEAF
    look, turn = np.flatnonzero(~done), np.zeros(nodes - done.sum(), np.int64)
    while len(look):
        place = np.full(len(trees.feature), -1)
        place[look] = np.arange(len(look))
        mine = place[node]
        kept = np.flatnonzero(mine >= 0)
        if len(kept) < len(mine):
            row, node, low, mine = row[kept], node[kept], low[kept], mine[kept]
        tried = _tried(seeds[look], turn, tries, width)
        own = tried[mine]
        key = ((mine[:, None] * tries + np.arange(tries)[None, :]) << 8 | flat.take(row[:, None] * width + own, mode="wrap")) << bits | low[:, None]
        key = key.ravel() if tried.min() >= 0 else key[own >= 0]
        key.sort()
        slot = key >> bits
        last = np.flatnonzero(np.concatenate((slot[1:] != slot[:-1], [True])))
        size = np.diff(last, prepend=-1)
        run = np.repeat(np.arange(len(last)), size)
        sums = np.bincount(run * classes + (key >> 4 & (1 << bits - 4) - 1), key & 15, len(last) * classes).reshape(-1, classes)
        sums = np.concatenate((sums.astype(np.int64), size[:, None]), 1)
        k, slot, cut, gain, left, total = best_splits(slot[last] >> 8, slot[last] & 255, sums, tries, _purity(weights[top[look]]), least)
        trees.feature[look] = LEAF
        again = (slot < 0) & ((turn[k] + 1) * tries < width)
        good = np.flatnonzero(slot >= 0)
        parents, chosen = look[k[good]], tried[k[good], slot[good]]
        np.add.at(taken, (top[parents], chosen), np.maximum(gain[good], 0.0))
        first = trees.split(parents, chosen, cut[good])
        top, seeds = np.concatenate((top, np.repeat(top[parents], 2))), np.concatenate((seeds, _below(seeds[parents])))
        sides = np.stack((left[good], total[good] - left[good]), 1).reshape(-1, classes + 1)
        child = np.stack((first, first + 1), 1).ravel()
        trees.values[child] = _shares(sides[:, :-1], weights[top[child]])
        done = (sides[:, -1] < 2 * least) | ((sides[:, :-1] > 0).sum(1) < 2)
        trees.feature[child[done]] = LEAF
        moving = np.flatnonzero(trees.feature[node] >= 0)
        at = node[moving]
        node[moving] = trees.left[at] + (bins[row[moving], trees.feature[at]] > trees.cut[at])
        look, turn = np.concatenate((look[k[again]], child[~done])), np.concatenate((turn[k[again]] + 1, np.zeros((~done).sum(), np.int64)))
    return trees, taken


def _grown_apart(
    rows: DataFrame, model: Trees, nodes: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, weights: np.ndarray, *, trees: int, seed: int, tries: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extends ``model`` by all that is below the given nodes; returns (node, feature, what the node's splits by it take from impurity).

    sizes: rows of the nodes, at most; seeds, weights: by node.  Nodes are dealt into groups of about equal size and rows to every
    group whose nodes they reach, once each; one task grows the nodes of a group."""
    width, classes = len(model.bounds), weights.shape[1]
    spark = rows.sparkSession
    whole = int(sizes.sum())
    groups = min(len(nodes), max(3 * spark.sparkContext.defaultParallelism, -(-whole * (width + 9) // GROUP_BYTES)))
    group_of = ((np.cumsum(sizes) - 1) * groups // max(1, whole)).astype(np.int64)
    place = np.full(len(model.feature), -1)
    place[nodes] = np.arange(len(nodes))
    shared = spark.sparkContext.broadcast((model.paths(), place, group_of, seeds, weights))
    kinds = {"code": np.int32, "bins": np.uint8, "row": np.int32, "draws": np.uint8, "node": np.int32}
    made = {"nodes": np.int64, "feature": np.int16, "cut": np.int16, "left": np.int32, "values": np.float64, "split": np.int64, "gain": np.float64}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, place, group_of = shared.value[:3]
        for batch in batches:
            for row, code, bins in _pieces(batch, width):
                n = drawn(row, np.arange(trees), seed)
                r, t = np.nonzero(n)
                mine = place[paths.leaves(bins, r, paths.roots[t])]
                open_ = mine >= 0
                r, mine, n = r[open_], mine[open_], n[r, t][open_]
                order = np.argsort(group_of[mine], kind="stable")
                own = group_of[mine[order]]
                for part in np.split(order, np.flatnonzero(own[1:] != own[:-1]) + 1) if len(own) else []:
                    used, at = np.unique(r[part], return_inverse=True)
                    found = {"code": code[used], "bins": bins[used], "row": at, "draws": n[part], "node": mine[part]}
                    blobs = [pa.array([found[c].astype(kind).tobytes()], pa.binary()) for c, kind in kinds.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(group_of[mine[part[:1]]].astype(np.int32)), *blobs], ["group", *kinds])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, after = [], 0
        for batch in batches:
            for blobs in zip(*(batch.column(k + 1).to_pylist() for k in range(len(kinds))), strict=True):
                piece = dict(zip(kinds, (np.frombuffer(b, kind) for b, kind in zip(blobs, kinds.values(), strict=True)), strict=True))
                piece["row"] = piece["row"] + np.int32(after)
                after += len(piece["code"])
                pieces.append(piece)
        if not pieces:
            return
        code, bins, row, draws, node = (np.concatenate([p[c] for p in pieces]) for c in kinds)
        pieces.clear()
        bins = bins.reshape(-1, width)
        order = np.argsort(node, kind="stable")
        node, row, draws = node[order], row[order], draws[order]
        names, start = np.unique(node, return_index=True)
        end = np.append(start[1:], len(node))
        a = 0
        while a < len(names):
            b = max(a + 1, int(np.searchsorted(end, start[a] + CELLS_AT_ONCE // tries, "right")))
            own = slice(start[a], end[b - 1])
            at = names[a:b]
            found, taken = grown(bins, code, row[own], draws[own].astype(np.int64), np.searchsorted(at, node[own]), shared.value[3][at], shared.value[4][at], tries, least)
            split = np.flatnonzero(taken)
            parts = (at, found.feature, found.cut, found.left, found.values, split, taken.ravel()[split])
            blobs = [np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(parts, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], list(made))
            a = b

    sent = rows.mapInArrow(deal, "group int, " + ", ".join(f"{c} binary" for c in kinds)).repartitionById(groups, F.col("group"))
    out = sent.mapInArrow(grow, ", ".join(f"{c} binary" for c in made)).toArrow().to_pylist()
    shared.unpersist()
    model.feature[nodes] = LEAF  # also those without rows
    found = [[np.frombuffer(x[c], kind) for c, kind in made.items()] for x in out]
    base, new, takes = len(model.feature), [], []
    for at, feature, cut, left, values, split, gain in sorted(found, key=lambda x: x[0][0]):
        k, own, values = len(at), nodes[at], values.reshape(-1, classes)
        left = np.where(feature >= 0, left + np.int64(base - k), 0)
        model.feature[own], model.cut[own], model.left[own], model.values[own] = feature[:k], cut[:k], left[:k], values[:k]
        new.append((feature[k:], cut[k:], left[k:], values[k:]))
        takes.append((at[split // width], split % width, gain))
        base += len(feature) - k
    if not new:
        return (np.zeros(0, np.int64),) * 3
    held = (model.feature, model.cut, model.left, model.values)
    model.feature, model.cut, model.left, model.values = (np.concatenate(x) for x in zip(held, *new, strict=True))
    return tuple(np.concatenate(x) for x in zip(*takes, strict=True))


@dataclass
class Forest:
    """A fitted forest: class probabilities are the mean of its trees' leaves.

    importance: by feature, what its splits take from the trees' Gini impurity, as shares of a tree and then their mean."""

    trees: Trees
    classes: int
    importance: np.ndarray

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        return self.trees.outputs(bins) / len(self.trees.roots)


def fit_forest(
    rows: DataFrame,
    bounds: list[np.ndarray],
    classes: int,
    *,
    trees: int = 400,
    min_leaf: int = 2,
    max_features: int | None = None,
    seed: int = 42,
    open_nodes: int = OPEN_NODES,
    node_bytes: int = NODE_BYTES,
) -> Forest:
    """A forest of the rows of :func:`binned`, without a bound on depth.

    Each tree has a Poisson bootstrap sample by hash and weighs classes by their rows in that sample.  A node tries ``max_features``
    features (the root of their number by default), and further ones until one can be split so that both sides keep ``min_leaf`` rows;
    the split of least Gini impurity is taken.  A step sums the histograms of at most ``open_nodes`` nodes.  Nodes whose rows take up to
    ``node_bytes`` are grown to their leaves by tasks that have these rows, all in one job.  The model, which grows with the rows as
    unbounded trees do, is held by the driver and sent to all tasks.
    """
    width, tries = len(bounds), max_features or max(1, int(np.sqrt(len(bounds))))
    weights = class_weights(rows, trees, classes, seed)
    model = Trees.planted(trees, bounds, classes)
    taken = np.zeros((trees, width))
    tree_of, seeds = np.arange(trees), mixed(np.arange(trees, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B9))
    whole, most = rows.count(), node_bytes // width
    queue = [(int(n), 0) for n in model.roots] if whole > most else []
    apart = [] if queue else [(model.roots, np.full(trees, max(1, whole)))]  # nodes that one task grows, and their rows
    while queue:
        part, queue = queue[:open_nodes], queue[open_nodes:]
        node, turn = (np.array(x) for x in zip(*part, strict=True))
        tried = _tried(seeds[node], turn, tries, width)
        place = np.full(len(model.feature), -1)
        place[node] = np.arange(len(node))
        own_weights = weights[tree_of[node]]
        shared = rows.sparkSession.sparkContext.broadcast((model.paths(), place, tried))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            paths, place, tried = shared.value
            for batch in batches:
                for row, code, bins in _pieces(batch, width):
                    n = drawn(row, np.arange(trees), seed)
                    r, t = np.nonzero(n)
                    mine = place[paths.leaves(bins, r, paths.roots[t])]
                    open_ = mine >= 0
                    r, mine, n = r[open_], mine[open_], n[r, t][open_]
                    own = tried[mine]
                    some, j = np.nonzero(own >= 0)
                    amounts = np.zeros((len(some), classes + 1), np.int64)
                    amounts[np.arange(len(some)), code[r[some]]] = n[some]
                    amounts[:, -1] = 1
                    yield _summed(mine[some] * tries + j, bins[r[some], own[some, j]], amounts)

        found = _step(rows, count, classes + 1, tries, _purity(own_weights), min_leaf)
        shared.unpersist()
        k = found["node"]
        model.feature[node] = LEAF  # also those without rows
        model.values[node[k]] = _shares(found["total"][:, :-1], own_weights[k])
        again = (found["slot"] < 0) & (found["total"][:, -1] >= 2 * min_leaf) & ((found["total"][:, :-1] > 0).sum(1) > 1) & ((turn[k] + 1) * tries < width)
        model.feature[node[k[again]]] = OPEN
        queue += [(int(node[x]), int(turn[x]) + 1) for x in k[again]]
        good = np.flatnonzero((found["slot"] >= 0) & ((found["total"][:, :-1] > 0).sum(1) > 1))
        parents = node[k[good]]
        chosen = tried[k[good], found["slot"][good]]
        np.add.at(taken, (tree_of[parents], chosen), np.maximum(found["gain"][good], 0.0))
        left = model.split(parents, chosen, found["cut"][good])
        tree_of = np.concatenate((tree_of, np.repeat(tree_of[parents], 2)))
        seeds = np.concatenate((seeds, _below(seeds[parents])))
        sides = np.stack((found["left"][good], found["total"][good] - found["left"][good]), 1).reshape(-1, classes + 1)
        child = np.stack((left, left + 1), 1).ravel()
        model.values[child] = _shares(sides[:, :-1], weights[tree_of[child]])
        done = (sides[:, -1] < 2 * min_leaf) | ((sides[:, :-1] > 0).sum(1) < 2)
        model.feature[child[done]] = LEAF
        few = ~done & (sides[:, -1] <= most)
        apart.append((child[few], sides[few, -1]))
        queue += [(int(n), 0) for n in child[~done & ~few]]
    node, sizes = (np.concatenate(x) for x in zip(*apart, strict=True))
    if len(node):
        at, chosen, gain = _grown_apart(rows, model, node, sizes, seeds[node], weights[tree_of[node]], trees=trees, seed=seed, tries=tries, least=min_leaf)
        np.add.at(taken, (tree_of[node[at]], chosen), gain)
    split = taken[taken.sum(1) > 0]
    return Forest(model, classes, (split / split.sum(1, keepdims=True)).mean(0) if len(split) else np.zeros(width))


# --- boosting ---


@dataclass
class Booster:
    """A fitted booster: probabilities are the softmax of the prior and the sums of its trees; tree k of each round speaks for class k."""

    prior: np.ndarray
    trees: Trees
    classes: int

    def probabilities(self, bins: np.ndarray) -> np.ndarray:
        return softmax(self.prior + self.trees.outputs(bins))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(scores: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """rows x classes x (gradient, hessian) of the softmax loss, as whole numbers."""
    p = softmax(scores)
    w = weight[code][:, None]
    g = p.copy()
    g[np.arange(len(code)), code] -= 1
    return np.rint(np.stack((g * w, p * (1 - p) * w), 2) * FIXED).astype(np.int64)


def best_first(gains: dict[int, float], children: dict[int, int], root: int, leaves: int) -> tuple[list[int], list[int]]:
    """(split nodes in order, nodes to look at next) of a tree that splits its leaf of largest gain until it has ``leaves``.

    gains: of the nodes looked at, none for those that cannot be split; children: the left child of those that have any."""
    edge, split, unknown = [root], [], []
    while len(split) < leaves - 1:
        known = [n for n in edge if gains.get(n, 0.0) > 0]
        if not known:
            break
        best = max(known, key=lambda n: (gains[n], -n))
        edge.remove(best)
        split.append(best)
        if best in children:
            edge += [children[best], children[best] + 1]
        else:
            unknown.append(best)
    return split, unknown


def fit_booster(
    rows: DataFrame,
    bounds: list[np.ndarray],
    classes: int,
    *,
    iterations: int = 400,
    rate: float = 0.06,
    leaves: int = 31,
    min_leaf: int = 10,
    l2: float = 0.5,
    keep: int = 10,
) -> Booster:
    """Multiclass gradient boosting with softmax loss over the rows of :func:`binned`, classes weighted inversely to their rows.

    A round grows one tree a class by Newton steps, best split first up to ``leaves`` leaves of at least ``min_leaf`` rows, all
    trees of the round in common steps: nodes that the order of splits may still reach are looked at together.  Scores are written
    every ``keep`` rounds, and rows replay only the trees since then.
    """
    width = len(bounds)
    found = rows.groupBy("code").agg(F.count("*").alias("n")).collect()  # at most classes
    n = np.zeros(classes)
    for r in found:
        n[r["code"]] = r["n"]
    weight = np.divide(n.sum(), (n > 0).sum() * n, out=np.zeros(classes), where=n > 0)
    prior = np.log(np.maximum(n * weight / max(1e-300, (n * weight).sum()), 1e-12))
    every = Trees(np.zeros(0, np.int64), bounds, np.zeros((0, classes)))
    scored, base = rows.withColumn("scores", F.lit(None).cast("binary")), None
    recent = Trees(np.zeros(0, np.int64), bounds, np.zeros((0, classes)))

    def scores_of(batch: pa.RecordBatch, bins: np.ndarray, since: Trees) -> np.ndarray:
        held = batch.column(3).to_pylist()
        start = np.tile(prior, (len(bins), 1)) if not held or held[0] is None else np.frombuffer(b"".join(held), np.float64).reshape(-1, classes)
        return start + since.outputs(bins)

    for k in range(iterations):
        own = Trees.planted(classes, bounds, classes)
        tree_of = np.arange(classes)
        gains, best, children = {}, {}, {}
        look = list(range(classes))
        while look:
            node = np.array(look)
            place = np.full(len(own.feature), -1)
            place[node] = np.arange(len(node))

            def count(batches: Iterator[pa.RecordBatch], place=place, own=own, since=recent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    code, bins = batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
                    gh = gradients(scores_of(batch, bins, since), code, weight)
                    for a in range(0, len(code), ROWS_AT_ONCE):
                        piece = bins[a : a + ROWS_AT_ONCE]
                        r, t = (x.ravel() for x in np.indices((len(piece), classes)))
                        mine = place[own.leaves(piece, r, own.roots[t])]
                        open_ = mine >= 0
                        r, t, mine = r[open_], t[open_], mine[open_]
                        amounts = np.concatenate((gh[a + r, t], np.ones((len(r), 1), np.int64)), 1)
                        slot = (mine[:, None] * width + np.arange(width)[None, :]).ravel()
                        yield _summed(slot, piece[r].ravel(), np.repeat(amounts, width, axis=0))

            def drop_in_loss(sums: np.ndarray, node: np.ndarray) -> np.ndarray:
                g, h = sums[:, 0] / FIXED, sums[:, 1] / FIXED
                return g * g / (h + l2)

            found = _step(scored, count, 3, width, drop_in_loss, min_leaf)
            for x, slot, cut, gain, total in zip(*(found[c] for c in ("node", "slot", "cut", "gain", "total")), strict=True):
                at = int(node[x])
                own.values[at, tree_of[at]] = -rate * (total[0] / FIXED) / (total[1] / FIXED + l2)
                if slot >= 0 and gain > 0:
                    gains[at], best[at] = float(gain), (int(slot), int(cut))
            look = []
            for root in range(classes):
                unknown = best_first(gains, children, root, leaves)[1]
                if unknown:
                    left = own.split(np.array(unknown), *(np.array(v) for v in zip(*[best[u] for u in unknown], strict=True)))
                    tree_of = np.concatenate((tree_of, np.full(2 * len(unknown), root)))
                    for u, c in zip(unknown, left.tolist(), strict=True):
                        children[u] = c
                        look += [c, c + 1]
        kept = {s for root in range(classes) for s in best_first(gains, children, root, leaves)[0]}
        own.feature[[x for x in range(len(own.feature)) if x not in kept]] = LEAF
        every, recent = _joined(every, own), _joined(recent, own)
        if (k + 1) % keep == 0 and k + 1 < iterations:
            since = recent

            def rescored(batches: Iterator[pa.RecordBatch], since=since) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
                    new = scores_of(batch, bins, since)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in new], pa.binary())], ["row", "code", "bins", "scores"])

            after = written(scored.mapInArrow(rescored, "row long, code int, bins binary, scores binary"), "scores")
            if base is not None:
                dropped(base)
            scored, base = after, after
            recent = Trees(np.zeros(0, np.int64), bounds, np.zeros((0, classes)))
    return Booster(prior, every, classes)


def _joined(a: Trees, b: Trees) -> Trees:
    """The trees of both."""
    n = len(a.feature)
    join = lambda x, y: np.concatenate((x, y))
    return Trees(join(a.roots, b.roots + n), b.bounds, join(a.values, b.values), join(a.feature, b.feature), join(a.cut, b.cut), join(a.left, np.where(b.feature >= 0, b.left + n, 0)))


# --- both ---


def with_probabilities(df: DataFrame, features: Sequence[str], model: Forest | Booster, name: str = "probability") -> DataFrame:
    """Adds the class probabilities of each row as an array."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def judged(values: pd.Series) -> pd.Series:
        model = shared.value
        rows = np.array([[np.nan if x is None else x for x in v] for v in values], np.float64).reshape(-1, len(model.trees.bounds))
        return pd.Series(list(model.probabilities(bin_of(rows, model.trees.bounds))))

    return df.withColumn(name, judged(F.array(*[F.col(f).cast("double") for f in features])))
