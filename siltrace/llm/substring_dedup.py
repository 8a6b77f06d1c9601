"""Substring deduplication with fixed-block anchors.

Every text is indexed by its non-overlapping blocks of half a window's words, and probed with every rolling window of a
block's size: any window of a repeat holds a whole block of the text that it repeats.  Probes that hit a block of another
text are extended: the windows around hits, and no others, are compared by hash, and those that stand in a text of smaller id
are merged into maximal exact repeats, which are removed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.exchange import BATCH_BYTES, Rounds, ids_of, mail, opened, to_batches, to_buckets
from siltrace.llm.kernels import Words, chunks, covered, rolling, runs, text_bytes

WINDOW = 50  # words

_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept string"


def _rolled(texts: pa.Table, sizes: tuple[int, ...]):
    """For each chunk: (first text, its Words, a tuple of (first word, hash, text) for each window size)."""
    buf, offsets = text_bytes(texts["text"])
    for lo, hi in chunks(offsets):
        own = offsets[lo : hi + 1]
        w = Words(buf[own[0] : own[-1]], own - own[0])
        yield lo, w, [rolling(w, k) for k in sizes], buf[own[0] : own[-1]]


def _unique(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, smallest doc, largest doc) of each distinct hash."""
    order = np.argsort(h, kind="stable")
    v, d = h[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    if not len(first):
        return v, d, d
    return v[first], np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)


def substring_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    filter_bits: int = 16,
    batch_bytes: int = BATCH_BYTES,
    carry: tuple[str, ...] = (),
    keep_layout: bool = False,
) -> DataFrame:
    """Remove every word in a ``window``-word sequence that also starts in a text of smaller id; judged on the input.

    One row per input row: (doc_id, n_words, n_removed, spans of removed words, kept words joined by one space).

    carry: further columns to return, none with the name of a result column (ValueError).  batch_bytes: of text in a task.  keep_layout: texts that lose nothing are returned as they were.
    filter_bits: probes travel as hashes of log2(words) + filter_bits bits, so that about one in 2**filter_bits is kept
    without need; windows are then compared by 64-bit hashes.  Null and empty texts have no words.  Rows of equal id never
    remove each other's words; null ids count as larger than all others.  Whole texts are used whatever their length; an
    empty table gives an empty result; other columns are not read.
    """
    block = window // 2
    rounds = Rounds(docs, id_col, text_col, carry, batch_bytes)
    n_buckets = rounds.buckets
    bits = min(62, filter_bits + max(10, math.ceil(math.log2(rounds.bytes / 4 + 2))))
    short = np.uint64(64 - bits)
    shards = np.uint64(n_buckets)

    def probe(batch: int, texts: pa.Table) -> pa.Table:
        ids = ids_of(texts)
        hashes, docs_, blocks = [], [], []
        for lo, w, ((s, h, text),), _ in _rolled(texts, (block,)):
            hashes.append(h >> short)
            docs_.append(ids[text + lo])
            blocks.append((h >> short)[(s - w.first[text]) % block == 0])
        v, least, most = _unique(np.concatenate(hashes), np.concatenate(docs_)) if hashes else (np.zeros(0, np.uint64),) * 3
        is_block = np.isin(v, np.concatenate(blocks)) if hashes else np.zeros(0, bool)
        coded = v << np.uint64(2) | (is_block.astype(np.uint64) << np.uint64(1)) | (least != most).astype(np.uint64)
        return mail(to_buckets((v % shards).astype(np.int64), batch, 0, coded))

    def hits(m: pa.Table) -> pa.Table:
        coded, batch = opened(m, 0, 1)
        v = coded >> np.uint64(2)
        order = np.argsort(v, kind="stable")
        v, coded, batch = v[order], coded[order], batch[order]
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
        if not len(first):
            return mail([])
        size = np.diff(np.append(first, len(v)))
        flags = np.bitwise_or.reduceat(coded, first)
        found = np.repeat((flags & np.uint64(2) > 0) & ((size > 1) | (flags & np.uint64(1) > 0)), size)
        return mail(to_batches(batch[found], 1, v[found]))

    def windows(batch: int, texts: pa.Table, m: pa.Table) -> pa.Table:
        hit = np.sort(opened(m, 1, 1)[0])
        if not len(hit):
            return mail([])
        ids = ids_of(texts)
        hashes, docs_ = [], []
        for lo, w, ((s, h, _), (s2, h2, text2)), _ in _rolled(texts, (block, window)):
            at = np.zeros(len(w.start) + 1, np.int64)
            v = h >> short
            at[s[hit[np.minimum(np.searchsorted(hit, v), len(hit) - 1)] == v] + 1] = 1
            sums = np.cumsum(at)
            near = sums[np.minimum(s2 + window - block + 1, len(w.start))] > sums[s2]
            hashes.append(h2[near])
            docs_.append(ids[text2[near] + lo])
        v, least, most = _unique(np.concatenate(hashes), np.concatenate(docs_))
        return mail(to_buckets((v >> np.uint64(32)).astype(np.int64) % n_buckets, batch, 0, v, least.astype(np.int64), (least != most).astype(np.uint64)))

    def repeats(m: pa.Table) -> pa.Table:
        v, doc, several, batch = opened(m, 0, 3)
        order = np.argsort(v, kind="stable")
        v, doc, several, batch = v[order], doc[order].view(np.int64), several[order], batch[order]
        if not len(v):
            return mail([])
        first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(v))))
        told = (doc > least) | (several > 0)
        return mail(to_batches(batch[told], 1, v[told], least[told]))

    def remove(_batch: int, texts: pa.Table, m: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_batches([], _OUT_ARROW)
        known, least, _ = opened(m, 1, 2)
        order = np.argsort(known, kind="stable")
        known, least = known[order], least[order].view(np.int64)
        ids = ids_of(texts)
        out: list[list] = [[], [], [], []]
        for lo, w, ((s, h, text),), buf in _rolled(texts, (window,)):
            flagged = np.zeros(len(s), bool)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                flagged = (known[at] == h) & (ids[text + lo] > least[at])
            gone = covered(len(w.start), s[flagged], window)
            # Bytes of the kept words, each followed by one space.
            lost = np.zeros(len(buf) + 1, np.int8)
            stay = np.flatnonzero(~gone)
            lost[w.start[stay]] += 1
            lost[w.end[stay]] -= 1
            take = np.cumsum(lost[:-1], dtype=np.int8) > 0
            length = np.zeros(len(w.start), np.int64)
            length[stay] = w.end[stay] - w.start[stay] + 1
            ends = np.cumsum(length)
            flat = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            place = np.ones(len(flat), bool)
            place[ends[stay] - 1] = False
            flat[place] = buf[take]
            edge = np.concatenate(([0], ends))[w.first]
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) if len(w.first) > 1 else np.zeros(0)
            removed = np.where(w.count > 0, removed, 0)
            s0, s1 = runs(gone)
            # A run that crosses from one text to the next is cut there.
            cuts = w.first[1:-1]
            inner = [c[(c > a) & (c < b)] for a, b, c in ((a, b, cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b)]) for a, b in zip(s0, s1, strict=True))]
            starts = np.sort(np.concatenate([s0, *inner])).astype(np.int64)
            stops = np.sort(np.concatenate([s1, *inner])).astype(np.int64)
            owner = w.text[starts] if len(starts) else starts
            per = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(w.count)))))
            for i in range(len(w.count)):
                out[0].append(int(w.count[i]))
                out[1].append(int(removed[i]))
                a, b = per[i], per[i + 1]
                out[2].append([{"first": int(x - w.first[i]), "last": int(y - 1 - w.first[i])} for x, y in zip(starts[a:b], stops[a:b], strict=True)])
                if keep_layout and not removed[i]:
                    out[3].append(texts["text"][lo + i].as_py())
                    continue
                out[3].append(flat[edge[i] : max(edge[i], edge[i + 1] - 1)].tobytes().decode())
        columns = [texts["doc_id"], *[pa.array(x, t) for x, t in zip(out, _OUT_ARROW.types[1:], strict=True)]]
        return pa.table(columns, schema=_OUT_ARROW)

    probes = rounds.ask(probe)
    found = rounds.answer(probes, hits)
    extended = rounds.answer(rounds.ask(windows, found), repeats)
    return rounds.finish(remove, _OUT, extended)


_OUT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("kept", pa.string()),
    ]
)


def substring_digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
