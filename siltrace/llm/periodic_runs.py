"""Periodic runs of words by the branching-tandem test on enhanced suffix arrays.

The words of a batch of texts are numbered, and their suffixes sorted by doubling: the buckets of the first 2**k words are
refined by the buckets 2**k words later, until no bucket has two suffixes.  The buckets of every depth are kept; they give
the longest common prefixes of neighbours in the array, and compare stretches of words anywhere.

Every interval of the LCP array, of depth d, holds the suffixes that share d words.  Of its child intervals all but the
largest are gone through: a suffix i for which ISA[i + d] or ISA[i - d] lies in the interval, but in another child, starts (or
ends) a square of period d whose next word breaks the period.  Rotating such a square to the left as far as the period goes
gives the whole run; the runs that several squares yield are merged, at their smallest period.  Intervals are stretches of
arrays: no tree is built, and suffixes are visited O(n log n) times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.kernels import Words, chunks, covered, joined_words, text_bytes, tidied, word_numbers

LEAST_LENGTH = 6  # words
LEAST_EXPONENT = 4

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixArray:
    """The sorted suffixes of several texts' words; those of one text never share a prefix with those of another.

    word, text: number and text of each word; end: where its text ends.  isa: place of each suffix in order; sa: the inverse;
    lcp: words that each suffix in order shares with the one before; ranks[k]: bucket of each suffix's first 2**k words.
    """

    def __init__(self, word: np.ndarray, text: np.ndarray, end: np.ndarray):
        n = len(word)
        self.end = end
        key = text << np.int64(32) | word
        order = np.argsort(key)
        new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))[:n]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(start, size)
        born = np.full(n, -1)  # of each border between suffixes in order: the depth, as a power of two, that tells them apart
        born[start] = 0
        active = np.sort(order[np.repeat(size > 1, size)])
        self.ranks = [rank.astype(np.int32)]
        while len(active):
            step = 1 << (len(self.ranks) - 1)
            later = np.zeros(len(active), np.int64)
            inside = active + step < end[active]
            later[inside] = rank[active[inside] + step] + 1
            pair = rank[active] * np.int64(n + 1) + later
            order = np.argsort(pair)
            active, pair = active[order], pair[order]
            new = np.concatenate(([True], pair[1:] != pair[:-1]))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(active)))
            own = rank[active[first]]
            head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            start = own + first - np.repeat(first[head], np.diff(np.append(head, len(own))))
            born[start[born[start] < 0]] = len(self.ranks)
            rank[active] = np.repeat(start, size)
            active = active[np.repeat(size > 1, size)]
            self.ranks.append(rank.astype(np.int32))
        self.isa = rank
        self.sa = np.empty(n, np.int64)
        self.sa[rank] = np.arange(n)
        self.lcp = self._common(born)

    def _common(self, born: np.ndarray) -> np.ndarray:
        out = np.zeros(len(born), np.int64)
        for k in range(1, len(self.ranks)):
            at = np.flatnonzero(born == k)
            i, j = self.sa[at], self.sa[at - 1]
            out[at] = (1 << (k - 1)) + self.forward(i + (1 << (k - 1)), j + (1 << (k - 1)), self.end[i], self.end[j], k - 1)
        return out

    def forward(self, i: np.ndarray, j: np.ndarray, end_i: np.ndarray, end_j: np.ndarray, levels: int) -> np.ndarray:
        """Words, fewer than 2**levels, that two different suffixes share."""
        i, j, begin = i.copy(), j.copy(), i
        for k in reversed(range(levels)):
            both = np.flatnonzero((i < end_i) & (j < end_j))
            both = both[self.ranks[k][i[both]] == self.ranks[k][j[both]]]
            i[both] += 1 << k
            j[both] += 1 << k
        return i - begin

    def backward(self, i: np.ndarray, period: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Words before i, none before ``least``, that equal those ``period`` later without a break."""
        at = i.copy()
        for k in reversed(range(len(self.ranks))):
            room = np.flatnonzero(at - (1 << k) >= least)
            back = at[room] - (1 << k)
            room = room[self.ranks[k][back] == self.ranks[k][back + period[room]]]
            at[room] -= 1 << k
        return i - at


def nearest_smaller(values: np.ndarray, step: int) -> np.ndarray:
    """Of each place with a positive value, the nearest one before (step -1) or after (1) with a smaller value; -1 or len(values)
    if there is none.  Others stand for themselves: they end the search of all that look past them."""
    n = len(values)
    padded = np.concatenate(([-1], values, [-1]))
    near = np.arange(n + 2) + step
    near[[0, -1]] = [0, n + 1]
    active = np.flatnonzero(padded > 0)
    while len(active):
        active = active[padded[near[active]] >= padded[active]]
        near[active] = near[near[active]]
    return near[1:-1] - 1


def branching_squares(s: SuffixArray, least_holders: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose period the next word breaks, in intervals of at least ``least_holders`` suffixes."""
    none = np.zeros(0, np.int64)
    if len(s.sa) < 2:
        return none, none
    left, right = nearest_smaller(s.lcp, -1), nearest_smaller(s.lcp, 1)
    border = np.flatnonzero((s.lcp > 0) & (right - left >= least_holders))
    if not len(border):
        return none, none
    # The interval [left, right) of each border; borders of one interval, in order, cut it into its children.
    border = border[np.argsort(left[border] * np.int64(len(s.sa) + 1) + s.lcp[border], kind="stable")]
    lo, hi, depth = left[border], right[border], s.lcp[border]
    new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(border)) - 1
    # Children by interval: one more than its borders.
    child_group = np.concatenate((group, np.arange(len(first))))
    child_start = np.concatenate((np.where(new, lo, np.concatenate(([0], border[:-1]))), border[last]))
    child_end = np.concatenate((border, hi[first]))
    size = child_end - child_start
    order = np.lexsort((size, child_group))
    largest = order[np.append(np.flatnonzero(np.diff(child_group[order])), len(order) - 1)]
    small = np.ones(len(size), bool)
    small[largest] = False
    found = []
    small = np.flatnonzero(small)
    for a, b in chunks(np.concatenate(([0], np.cumsum(size[small])))):
        own = small[a:b]
        count = size[own]
        total = np.cumsum(count)
        place = np.repeat(child_start[own] - (total - count), count) + np.arange(total[-1])
        i = s.sa[place]
        c0, c1 = np.repeat(child_start[own], count), np.repeat(child_end[own], count)
        g0, g1, d = (np.repeat(x[first][child_group[own]], count) for x in (lo, hi, depth))
        for j in (i + d, i - d):
            inside = np.flatnonzero((j >= 0) & (j < len(s.isa)))
            at = s.isa[j[inside]]
            hit = inside[(at >= g0[inside]) & (at < g1[inside]) & ((at < c0[inside]) | (at >= c1[inside]))]
            found.append((np.minimum(i, j)[hit], d[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(word: np.ndarray, text: np.ndarray, first: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, in order; first: where each text's words begin, and the end of the last."""
    if not len(word):
        return (np.zeros(0, np.int64),) * 3
    s = SuffixArray(word, text, first[text + 1])
    # A run of exponent e has at least e suffixes that share its last period.
    i, period = branching_squares(s, least_exponent)
    start = i - s.backward(i, period, first[text[i]])
    end = i + 2 * period
    long = end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _found(least_length: int, least_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                piece = buf[own[0] : own[-1]]
                w = Words(piece, own - own[0], None)
                start, end, period = runs_of(word_numbers(piece, w), w.text, w.first, least_length, least_exponent)
                owner = w.text[start]
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (start - w.first[owner], end - start, period)], fields=list(_RUN))
                cut = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
                gone = covered(len(w.start), start + period, end - start - period)
                columns = [batch.column(0).slice(a, b - a), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(cut, runs), joined_words(piece, w, ~gone)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> DataFrame:
    """One row per input row: (doc_id, n_words, runs, collapsed).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared byte by byte.  runs: (start, length, period) in order of start,
    then period, of each stretch with smallest period q and at least ``least_length`` and ``least_exponent`` * q words (an
    exponent of 2 or more, ValueError) that no neighbouring word extends.  collapsed: the words, joined by one space, without
    those that any run contains after its first q words.

    Null and empty texts have no words and no runs.  Texts never share runs, whatever their ids: repeated rows and ids are
    judged one by one, a null id stays null.  Whole texts are used; a task holds 1 MB of them or one longer text, and as
    many arrays of 4 bytes a word as the longest repeat has binary digits.  No row is shuffled, so no key can be hot.  An empty
    table gives an empty result; other columns are not read.
    """
    if least_exponent < 2:
        raise ValueError("a run has at least two periods")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return source.mapInArrow(tidied(_found(least_length, least_exponent)), schema)


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period), counts and digests of :func:`periodic_runs`."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    own = found.withColumn("_best", best)
    length, period = -F.col("_best.shorter"), F.col("_best.period")
    return own.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
