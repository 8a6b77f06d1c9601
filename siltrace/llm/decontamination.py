"""Benchmark decontamination by a prefix-filtered set join.

Every ``window`` consecutive words of a benchmark item are a set of positional shingles, of which a text must hold all to hold
the window.  So one necessary shingle, its prefix, is enough to find the window: shingles are ordered by how often the corpus
holds them, and each window is filed under its rarest.  A window one of whose shingles the corpus lacks can stand nowhere.

1.  A pass over the texts counts those shingles that benchmark windows have.
2.  A second pass finds the prefix shingles and cuts out the words around each, as far as a window can reach: within the text
    (length bound).
3.  Distinct surroundings meet the windows of their shingle where its place in the window leaves room on both sides
    (positional bound), and are compared word by word.  Copies of a passage meet the benchmark once.

Between texts and shingles stands a table of bits of bounded size, made from the shingles; what it lets through by chance finds
no partner in the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltrace.llm.digests import joined_digests
from siltrace.llm.kernels import _LOWER_CODES, _LOWERED, Words, chunks, joined_ranges, rolling, text_bytes, tidied
from siltrace.llm.storage import written
from siltrace.operators.joins import looked_up

WINDOW = 10  # words
SHINGLE = 3
FILTER_BITS = 27  # at most, as a power of two: a table of 16 MB

_SPLIT = np.ones(256, bool)  # bytes between words
_SPLIT[0x30:0x3A] = _SPLIT[0x41:0x5B] = _SPLIT[0x61:0x7B] = _SPLIT[0x80:] = False
_LOWER = _LOWERED.astype(np.uint8)


def _windows(window: int, shingle: int):
    """From (item, text) to (item, window's words, hashes of its shingles, words of a shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, 1 << 17):
                own = offsets[a : b + 1]
                piece = buf[own[0] : own[-1]]
                w = Words(piece, own - own[0], _LOWER_CODES, _SPLIT)
                size = np.minimum(w.count, window)
                count = np.where(size > 0, w.count - size + 1, 0)
                text = np.repeat(np.arange(b - a), count)
                start = w.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                words = joined_ranges(_LOWER[piece], w, start, start + size[text])
                k = np.minimum(size, shingle)[text]
                tokens = np.zeros(0, np.int64)
                kinds = size[text] - k + 1
                at = np.repeat(start, kinds) + np.arange(kinds.sum()) - np.repeat(np.cumsum(kinds) - kinds, kinds)
                tokens = np.zeros(len(at), np.uint64)
                for n in range(1, shingle + 1):
                    first, h, _ = rolling(w, n)
                    mine = np.repeat(k, kinds) == n
                    tokens[mine] = h[np.searchsorted(first, at[mine])]
                cut = pa.array(np.concatenate(([0], np.cumsum(kinds))).astype(np.int32))
                lists = pa.ListArray.from_arrays(cut, pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(text)), words, lists, pa.array(k.astype(np.int32))], ["item", "words", "tokens", "k"]
                )

    return run


class Bits:
    """A table of bits, two for each token; what is not in it is no token."""

    def __init__(self, tokens: DataFrame, most: int):
        """tokens: distinct (token, k).  Only the table comes to the driver."""
        self.sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most as many as a shingle has words
        self.log = int(min(most, max(16, np.ceil(np.log2(tokens.count() + 1)) + 8)))
        high, low = F.shiftrightunsigned("token", 64 - self.log), F.col("token").bitwiseAND((1 << self.log) - 1)
        bit = tokens.select(F.explode(F.array(high, low)).alias("bit"))
        word = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
        found = word.toArrow()
        table = np.zeros(1 << (self.log - 6), np.uint64)
        table[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
        self.table = tokens.sparkSession.sparkContext.broadcast(table)

    def holds(self, h: np.ndarray) -> np.ndarray:
        table = self.table.value
        test = lambda bit: (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        out = test(h >> np.uint64(64 - self.log))
        some = np.flatnonzero(out)
        out[some] = test(h[some] & np.uint64((1 << self.log) - 1))
        return out


def _counted(bits: Bits):
    """From (text) to (token, n): how often texts hold the shingles of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                w = Words(buf[own[0] : own[-1]], own - own[0], _LOWER_CODES, _SPLIT)
                found = [h[bits.holds(h)] for _, h, _ in (rolling(w, k) for k in bits.sizes)]
                token, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


_HIT = pa.struct([("at", pa.int32()), ("before", pa.int32()), ("token", pa.int64()), ("around", pa.string())])


def _probed(bits: Bits, window: int, shingle: int):
    """From (doc_id, text) to (doc_id, n_words, hits): prefix shingles, and the words around each that a window could take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                piece = buf[own[0] : own[-1]]
                w = Words(piece, own - own[0], _LOWER_CODES, _SPLIT)
                found = []
                for k in bits.sizes:
                    start, h, text = rolling(w, k)
                    hit = bits.holds(h)
                    reach = window - k if k == shingle else 0  # a shorter shingle is a whole window
                    found.append((start[hit], h[hit], text[hit], np.full(int(hit.sum()), k), np.full(int(hit.sum()), reach)))
                start, h, text, k, reach = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
                order = np.argsort(text, kind="stable")
                start, h, text, k, reach = (x[order] for x in (start, h, text, k, reach))
                lo, hi = np.maximum(start - reach, w.first[text]), np.minimum(start + k + reach, w.first[text + 1])
                columns = [
                    pa.array((start - w.first[text]).astype(np.int32)),
                    pa.array((start - lo).astype(np.int32)),
                    pa.array(h.astype(np.uint64).view(np.int64)),
                    joined_ranges(_LOWER[piece], w, lo, hi),
                ]
                cut = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                hits = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(columns, fields=list(_HIT)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(w.count.astype(np.int64)), hits], ["doc_id", "n_words", "hits"])

    return run


def _window_id(words: Column) -> Column:
    return F.substring(F.sha2(words, 256), 1, 32)


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, window, size, token, offset, k): each distinct window with its rarest shingle, but those that the corpus cannot hold."""
    each = windows.select("words", "k", F.posexplode("tokens").alias("offset", "token"))
    held = each.groupBy("token").agg(F.count("*").alias("held"))
    known = looked_up(looked_up(each, counts, ["token"]), held, ["token"])
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "held", "token", "offset")).alias("rarest")
    chosen = known.groupBy("words", "k").agg(rarest).filter("rarest.n > 0")
    return chosen.select("words", _window_id(F.col("words")).alias("window"), F.size(F.split("words", " ")).alias("size"), "k", "rarest.token", "rarest.offset")


def verified(hits: DataFrame, prefix: DataFrame) -> DataFrame:
    """(token, before, around, covered, windows): of distinct surroundings, the words of a window, as places from the shingle, and the windows."""
    around = hits.select("token", "before", "around").distinct().withColumn("near", F.split("around", " "))
    met = around.join(prefix.drop("k"), "token").filter(
        (F.col("offset") <= F.col("before"))
        & (F.size("near") >= F.col("before") - F.col("offset") + F.col("size"))
        & (F.array_join(F.slice("near", F.col("before") - F.col("offset") + 1, F.col("size")), " ") == F.col("words"))
    )
    # At most one window of each size starts at a place.
    places = F.sequence(-F.col("offset"), F.col("size") - F.col("offset") - 1)
    return met.groupBy("token", "before", "around").agg(
        F.array_distinct(F.flatten(F.collect_list(places))).alias("covered"), F.collect_set("window").alias("windows")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, hit_words, n_items, items_sha256, contaminated).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered.  Each ``window`` consecutive words of an item are a window;
    an item of fewer words, but not none, is one.  hit_words: the places, from 0 and in order, of the text's words inside any occurrence of
    a window.  n_items: items with such windows; items_sha256: SHA-256 of their ids, sorted as strings and joined by commas.

    Null and empty texts have no words and are clean; items without words find nothing.  Rows of one item id are one item; a
    null id counts as the empty string.  Repeated rows and ids of texts are judged one by one.  Whole texts are used whatever
    their length, with as many hits as they have.  An empty table on either side gives no windows or no rows.  Other columns
    are not read.

    Memory: a task holds 1 MB of texts or one longer text; the table of bits has at most 2**filter_bits bits (with many times
    2**(filter_bits - 8) shingles of windows it lets more and more through, which costs time and changes no result).  Frequent
    shingles and surroundings are sent to all tasks (at most 1,000); what a hot passage costs is a row for each prefix shingle
    and text.  The list of all items of a text is hashed row by row, once for all texts that hold the same windows.
    """
    if window < shingle or shingle < 1:
        raise ValueError("a window holds at least one shingle")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    made = items.mapInArrow(tidied(_windows(window, shingle)), "item string, words string, tokens array<long>, k int")
    all_windows = written(made, "item-windows")
    windows = written(all_windows.select("words", "tokens", "k").dropDuplicates(["words"]), "windows")
    tokens = written(windows.select(F.explode("tokens").alias("token"), "k").distinct(), "window-shingles")
    counts = source.select("text").mapInArrow(tidied(_counted(Bits(tokens, filter_bits))), "token long, n long")
    counts = written(counts.groupBy("token").agg(F.sum("n").alias("n")), "shingle-counts")
    prefix = written(prefixes(windows, counts), "prefixes")
    marked = source.mapInArrow(
        tidied(_probed(Bits(prefix.select("token", "k").distinct(), filter_bits), window, shingle)),
        "doc_id long, n_words long, hits array<struct<at:int,before:int,token:long,around:string>>",
    )
    marks = written(marked.withColumn("rid", F.monotonically_increasing_id()), "marks")
    hits = marks.filter(F.size("hits") > 0).select("rid", F.inline("hits"))
    found = written(verified(hits, prefix), "surroundings")
    met = looked_up(hits, found, ["token", "before", "around"]).filter(F.col("covered").isNotNull())
    # A text's hits are at most its words.
    own = met.groupBy("rid").agg(F.collect_list(F.struct("at", "covered")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"))
    words = F.flatten(F.transform("hits", lambda h: F.transform(h["covered"], lambda c: h["at"] + c)))
    texts = written(own.select("rid", F.array_sort(F.array_distinct(words)).alias("hit_words"), "windows", F.sha2(F.array_join("windows", ""), 256).alias("held")), "hit-texts")

    # Texts that hold the same windows hold windows of the same items.
    held = texts.select("held", "windows").dropDuplicates(["held"]).select("held", F.explode("windows").alias("window"))
    of = all_windows.select(_window_id(F.col("words")).alias("window"), "item").distinct()
    listed = held.join(of, "window").select("held", "item").distinct()
    digests = written(joined_digests(listed, "held", ["item"], "item").toDF("held", "n_items", "items_sha256"), "item-lists")
    judged = looked_up(texts.select("rid", "hit_words", "held"), digests, ["held"])
    out = marks.select("rid", "doc_id", "n_words").hint("merge").join(judged, "rid", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
    )
