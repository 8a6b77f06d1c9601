"""MinHash near-duplicate components with an LSH forest.

Texts with one shingle set form a class, whose key is a hash of the set's size and two fingerprints.  Each of several trees orders the classes by its own
row of minhash values.  Classes that share at least ``depth`` leading values lie in one region.  In a region of moderate
size all pairs whose signatures agree well enough are candidates; in a crowded one the prefix is deepened until regions are
small, and each class is also paired with its neighbours by longest common prefix in the sorted order.  Candidates are
confirmed on the full shingle sets: first each class's best partner, then all candidates that still lie in different
components, so that no candidate that could join two components goes unconfirmed.  Last, the classes of crowded regions that
still hold several components are compared on their full sets, block against block: a task counts the common shingles of all
pairs of two blocks at once, as a product of matrices over the shingles that both hold, and gives out which components meet, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.components import connected_components, relabelled
from siltrace.llm.exchange import mail, pack, to_buckets, unpack
from siltrace.llm.kernels import _LOWER_CODES, Words, chunks, mix, range_hash, range_sums, release_memory, text_bytes, tidied
from siltrace.llm.storage import dropped, written
from siltrace.operators.ranks import cumulated

TREES, LEVELS = 12, 8
DEPTH = 2  # shared leading values that make a region: 1 - (1 - 0.8**2)**12 of all pairs at 0.8 meet in some tree
CROWDED = 64  # classes in a region beyond which it is split by deeper prefixes
NEIGHBOURS = 12  # classes after each in a crowded region's sorted order that are paired with it
HOT_REGION = 1 << 16  # classes in a region beyond which it is dealt over several tasks by its deeper prefixes
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19  # classes, and shingles, of a crowded region that are compared at once
LEAST_AGREEMENT = 0.6  # of signatures: five standard deviations below a similarity of 0.8

_RNG = np.random.Generator(np.random.PCG64(977))
_FLIP = _RNG.integers(1, 2**64, TREES * LEVELS, dtype=np.uint64)
_FACTOR = _RNG.integers(1, 2**64, TREES * LEVELS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each text's distinct ``size``-word shingles; a shorter text's whole sequence is its only one."""
    w = Words(buf, offsets, _LOWER_CODES)
    sums = range_sums(w.hash)
    count = np.where(w.count >= size, w.count - size + 1, np.minimum(w.count, 1))
    text = np.repeat(np.arange(len(count)), count)
    start = w.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    h = range_hash(sums, start, np.minimum(start + size, w.first[1:][text]))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minhash values (texts x trees*levels); rows of empty sets hold the largest value."""
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.full((len(at) - 1, TREES * LEVELS), 0xFFFFFFFF, np.uint32)
    if len(full):
        for j in range(TREES * LEVELS):
            out[full, j] = np.minimum.reduceat(((h ^ _FLIP[j]) * _FACTOR[j] >> np.uint64(32)).astype(np.uint32), at[full])
    return out


KEY = ("n_shingles", "set_sum", "set_xor")


def _key(h: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Size and two fingerprints of each set: what tells classes apart."""
    prints = np.zeros((2, len(at) - 1), np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        prints[0, full] = np.add.reduceat(h, at[full])
        prints[1, full] = np.bitwise_xor.reduceat(mix(h * np.uint64(0xD6E8FEB86659FD93)), at[full])
    return [pa.array(np.diff(at).astype(np.int64)), *[pa.array(x.view(np.int64)) for x in prints]]


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_bytes(batch.column(1))
        for lo, hi in chunks(offsets):
            own = offsets[lo : hi + 1]
            h, at = shingle_sets(buf[own[0] : own[-1]], own - own[0], size)
            sig = pa.array([r.tobytes() for r in signatures(h, at)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *_key(h, at), sig], ["doc_id", *KEY, "signature"])


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each value, two values to a byte."""
    low = (sig & 15).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


_SAME = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def _region_keys(sig: np.ndarray, tree: int) -> np.ndarray:
    """Names of the regions of some classes in a tree."""
    own = sig[:, tree * LEVELS : tree * LEVELS + DEPTH].astype(np.uint64)
    key = np.full(len(sig), tree + 1, np.uint64)
    for d in range(DEPTH):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + own[:, d])
    return key


def _signatures_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint32).reshape(batch.num_rows, -1)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, n): how many of a batch's classes lie in each region of each tree."""
    for batch in batches:
        sig = _signatures_of(batch, 0)
        key, n = np.unique(np.concatenate([_region_keys(sig, t) for t in range(TREES)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["region", "n"])


def _plant(n_buckets: int, hot: np.ndarray):
    """From (id, n, signature) to mail: each class once in every tree's bucket; regions in ``hot`` are dealt by their next levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures_of(batch, 2)
            nibbles = _nibbles(sig)
            words = nibbles.view(np.uint64).reshape(batch.num_rows, -1)
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = []
            for t in range(TREES):
                region = _region_keys(sig, t)
                key, split = region.copy(), np.isin(region, hot)
                for level in range(DEPTH // 2, LEVELS // 2 - 1):
                    deeper = nibbles[split, t * LEVELS // 2 + level].astype(np.uint64)
                    key[split] = mix(key[split] * np.uint64(0x9E3779B97F4A7C15) + deeper)
                rows += to_buckets((key % np.uint64(n_buckets)).astype(np.int64), t, 0, key, region, ids, n, *words.T)
            yield from mail(rows).to_batches()

    return run


def _region_pairs(words: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j), those whose sizes and signatures allow a similarity of 0.8, and their agreement."""
    near = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    i, j = i[near], j[near]
    same = np.zeros(len(i))
    for lo in range(0, len(i), 1 << 16):
        x = (words[i[lo : lo + (1 << 16)]] ^ words[j[lo : lo + (1 << 16)]]).view(np.uint8)
        same[lo : lo + (1 << 16)] = _SAME[x].sum(1)
    agreement = (same / (TREES * LEVELS) - 1 / 16) * 16 / 15
    good = agreement >= LEAST_AGREEMENT
    return i[good], j[good], agreement[good]


def _candidates(table: pa.Table) -> pa.Table:
    """Of one bucket's regions: candidate pairs (a < b), and as (a, region, size) the classes of crowded ones."""
    parts = [(t, unpack(x)) for t, x in zip(table["batch"].to_pylist(), table["blob"].to_pylist(), strict=True)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    crowd: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for tree in sorted({t for t, _ in parts}):
        key, whole, ids, n, *words = (np.concatenate(x) for x in zip(*[p for t, p in parts if t == tree], strict=True))
        ids, n, words = ids.view(np.int64), n.astype(np.int64), np.stack(words, 1)
        path = np.ascontiguousarray(words.view(np.uint8)[:, tree * LEVELS // 2 : (tree + 1) * LEVELS // 2]).view(">u4").ravel()
        order = np.lexsort((ids, path, key))
        key, whole, path, ids, n, words = key[order], whole[order], path[order], ids[order], n[order], words[order]
        region = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(region, len(key)))
        tasks = [(a, a + s, DEPTH) for a, s in zip(region[size > 1].tolist(), size[size > 1].tolist(), strict=True)]
        full = np.repeat(size > CROWDED, size) | (key != whole)  # parts of hot regions are crowded whatever their size
        crowd.append((ids[full], whole[full].view(np.int64), n[full]))
        left, right = [], []
        while tasks:
            a, b, depth = tasks.pop()
            m = b - a
            if m <= CROWDED:
                i, j = np.triu_indices(m, 1)
                left.append(i + a)
                right.append(j + a)
                continue
            for d in range(1, NEIGHBOURS + 1):
                left.append(np.arange(a, b - d))
                right.append(np.arange(a + d, b))
            if depth < LEVELS:
                # Two levels to a byte of the path: split by the next byte.
                depth += 2 - depth % 2
                own = path[a:b] >> np.uint32(8 * (LEVELS - depth) // 2)
                cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                tasks += [(a + x, a + y, depth) for x, y in zip(cut.tolist(), np.append(cut[1:], m).tolist(), strict=True) if y - x > 1]
        if left:
            i, j, agreement = _region_pairs(words, n, np.concatenate(left), np.concatenate(right))
            out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), agreement))
    release_memory()
    a, b, g = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    pairs = pa.table({"a": a[order][new], "b": b[order][new], "agreement": g[order][new]})
    names = ("a", "region", "size")
    members = pa.table(dict(zip(names, (np.concatenate(x) for x in zip(*crowd, strict=True)), strict=True))) if crowd else pa.table({x: pa.array([], pa.int64()) for x in names})
    return pa.concat_tables([pairs, members], promote_options="default")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = text_bytes(batch.column(1))
        for lo, hi in chunks(offsets):
            own = offsets[lo : hi + 1]
            h, at = shingle_sets(buf[own[0] : own[-1]], own - own[0], size)
            blobs = [pack(np.sort(h[a:b] >> np.uint64(16))) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*_key(h, at), pa.array(blobs, pa.binary())], [*KEY, "shingles"])


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, y = [], None, None
            b, xs, ys = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            for i in range(len(b)):  # one pair's sets are unpacked at a time
                if last != b[i]:
                    last, y = b[i], unpack(ys[i].as_py())[0]
                x = unpack(xs[i].as_py())[0]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i not in (2, 3)], [n for n in batch.schema.names if n not in "xy"]).take(pa.array(good, pa.int64()))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b, ...) whose full sets have a Jaccard similarity of at least ``threshold`` percent; other columns are long."""
    # Merge joins at every size: pairs and sets both grow with the corpus.
    sets, more = sets.hint("merge"), [c for c in pairs.columns if c not in ("a", "b")]
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y", *more)
    return both.mapInArrow(tidied(_confirmed(threshold)), ", ".join(f"{c} long" for c in ("a", "b", *more)))


def common_counts(x: list[np.ndarray], y: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, as products of 0/1 matrices over the elements of both sides."""
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (x, y)]
    row = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), np.int64)
    at = [np.searchsorted(both, f) if len(both) else np.zeros(len(f), np.int64) for f in flat]
    held = [(a < len(both)) & (both[np.minimum(a, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat, strict=True)]
    at, row = [a[h] for a, h in zip(at, held, strict=True)], [r[h] for r, h in zip(row, held, strict=True)]
    order = [np.argsort(a, kind="stable") for a in at]
    at, row = [a[o] for a, o in zip(at, order, strict=True)], [r[o] for r, o in zip(row, order, strict=True)]
    for lo in range(0, len(both), step):
        sides = []
        for a, r, n in zip(at, row, (len(x), len(y)), strict=True):
            i, j = np.searchsorted(a, [lo, lo + step])
            side = np.zeros((n, min(step, len(both) - lo)), np.float32)
            side[r[i:j], a[i:j] - lo] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def met_components(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From pairs of linked components to a link of each to the smallest that it reaches over these pairs."""
    names, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _compared(threshold: int):
    """Of two blocks of classes (or one with itself): the components that a link joins."""

    def run(table: pa.Table) -> pa.Table:
        side, component = table["side"].to_numpy(), table["component"].to_numpy()
        sets = [unpack(x.as_py())[0] for x in table["shingles"].combine_chunks()]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        x, y = [sets[k] for k in left], [sets[k] for k in right]
        common = common_counts(x, y)
        n, m = np.array([len(v) for v in x]), np.array([len(v) for v in y])
        i, j = np.nonzero((100 * common >= threshold * (n[:, None] + m[None, :] - common)) & (component[left][:, None] != component[right][None, :]))
        a, b = met_components(component[left[i]], component[right[j]])
        release_memory()
        return pa.table({"ca": a, "cb": b})

    return run


def crowded_links(crowds: DataFrame, components: DataFrame, sets: DataFrame, threshold: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame | None:
    """Links (ca, cb) that join components among the classes of each crowded region; None if no region holds several components.

    A region's classes, ordered by component, are cut into blocks of at most ``block`` classes and about ``block_shingles``
    shingles, over ranges of the order; blocks of one and the same component need not meet.  Every other pair of blocks of a
    region is one group, whatever the size of the region.
    """
    own = crowds.select("region", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = own.groupBy("region").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("region")
    own = own.distinct().join(mixed, "region", "left_semi").hint("merge").join(sets.select("id", "n_shingles"), "id")
    own = written(own, "crowds")
    if own.isEmpty():
        return None
    placed = cumulated(own, [F.col("component"), F.col("id")], {"place": F.lit(1), "before": F.col("n_shingles")}, by=["region"])
    name = F.struct(F.floor(F.col("place") / block).alias("i"), F.floor(F.col("before") / block_shingles).alias("j")).alias("block")
    placed = written(placed.select("region", "id", "component", name), "crowd-blocks")
    blocks = placed.groupBy("region", "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    x, y = (blocks.select("region", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "c0", "c1")]) for side in "xy")
    met = x.hint("merge").join(y, "region").filter("block_x <= block_y AND (c0_x <> c1_x OR c0_y <> c1_y OR c0_x <> c0_y)")
    met = written(met.select("region", "block_x", "block_y"), "block-pairs")
    members = placed.hint("merge").join(sets.select("id", "shingles"), "id").select("region", "block", "component", "shingles")
    members = written(members, "crowd-sets", "none")
    left = met.hint("merge").join(members.withColumnRenamed("block", "block_x"), ["region", "block_x"]).withColumn("side", F.lit(0))
    right = met.filter("block_x < block_y").hint("merge").join(members.withColumnRenamed("block", "block_y"), ["region", "block_y"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).select(F.xxhash64("region", "block_x", "block_y").alias("pair"), "side", "component", "shingles")
    links = written(both.groupBy("pair").applyInArrow(_compared(threshold), "ca long, cb long").distinct(), "crowd-links")
    for table in (own, placed, met, members):
        dropped(table)
    return None if links.isEmpty() else links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80, hot_region: int = HOT_REGION) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    Texts are linked at a Jaccard similarity of at least ``threshold`` percent (80 or more) of their distinct ``shingle``-word
    sets, A-Z lowered; component_id is the smallest doc_id reachable over links, and the row that bears it is kept.

    A text with fewer words has one shingle, its whole sequence.  Null texts and texts without words have none, are linked
    with nothing and kept.  Rows of one doc_id share a component if their texts do.  A null doc_id represents nothing: alone,
    its component_id is null and the row is kept.  Whole texts are used; an empty table gives an empty result; other columns are not read.
    """
    if threshold < 80:
        raise ValueError("the forest is built for similarities of at least 80 percent")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = source.mapInArrow(
        tidied(lambda it: _fingerprints(it, shingle)), "doc_id long, n_shingles long, set_sum long, set_xor long, signature binary"
    )
    marks = written(marks, "signatures")
    class_id = F.xxhash64(*KEY).alias("id")
    marked = marks.filter(F.col("n_shingles") > 0)
    classes = marked.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature")).filter("least IS NOT NULL")
    classes = written(classes.withColumn("id", class_id), "classes")
    n_classes = classes.count()
    n_buckets = max(12, n_classes // 4096)
    hot = np.zeros(0, np.uint64)
    if n_classes > hot_region:  # a smaller table has no such region
        sizes = classes.select("signature").mapInArrow(tidied(_regions), "region long, n long").groupBy("region").agg(F.sum("n").alias("n"))
        few = sizes.filter(F.col("n") > hot_region).select("region").toArrow()  # at most TREES * classes / hot_region numbers
        hot = few["region"].to_numpy().view(np.uint64)
    plant = classes.select("id", "n_shingles", "signature").mapInArrow(tidied(_plant(n_buckets, hot)), "bucket long, batch long, kind int, blob binary")
    found = written(plant.groupBy("bucket").applyInArrow(_candidates, "a long, b long, agreement double, region long, size long"), "regions")
    pairs = written(found.filter("region IS NULL").groupBy("a", "b").agg(F.max("agreement").alias("agreement")), "candidates")
    crowds = found.filter("region IS NOT NULL").select("region", F.col("a").alias("id"))

    # The full set of a class is made from the text of its smallest id; other texts of that id make sets that nothing asks for.
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowds.select("id")).distinct()
    holders = classes.select("id", "least").join(wanted, "id", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    texts = source.hint("merge").join(holders, "doc_id", "left_semi").select("doc_id", "text")
    made = texts.mapInArrow(tidied(lambda it: _sets(it, shingle)), "n_shingles long, set_sum long, set_xor long, shingles binary")
    sets = written(made.filter("n_shingles > 0").select(class_id, "n_shingles", "shingles").dropDuplicates(["id"]), "sets", "none")

    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agreement", -F.col("a"))).alias("a"))
    # Each class's best partner has the smaller key of the two: these links are a forest.
    components = connected_components(confirm(best.select("a", "b"), sets, threshold))

    def labelled(pairs: DataFrame, column: str, to: str) -> DataFrame:
        own = components.select(F.col("id").alias(column), F.col("component").alias(to))
        return pairs.hint("merge").join(own, column, "left").withColumn(to, F.coalesce(to, column))

    joins = lambda links: connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    apart = labelled(labelled(pairs.select("a", "b"), "a", "ca"), "b", "cb").filter("ca <> cb")
    components = relabelled(components, joins(confirm(apart.select("a", "b", "ca", "cb"), sets, threshold)))
    rest = crowded_links(crowds, components, sets, threshold)
    if rest is not None:
        components = relabelled(components, joins(rest))

    # A component is named by the smallest doc_id of its classes.
    linked = components.hint("merge").join(classes.select("id", "least"), "id")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    members = classes.select(*KEY, "id", "least").hint("merge").join(named, "id", "left").select(*KEY, F.coalesce("component_id", "least").alias("component_id"))
    known = marked.drop("signature").hint("merge").join(members, list(KEY), "left")
    empty = marks.filter(F.col("n_shingles") == 0).drop("signature").withColumn("component_id", F.lit(None).cast("long"))
    return known.unionByName(empty).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.col("component_id").isNull()).alias("kept"),
    )
