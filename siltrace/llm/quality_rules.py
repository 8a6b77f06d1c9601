"""Quality rules: per-text counts, and cross-document line frequency.

Lines are normalised (A-Z lowered, white space collapsed) and hashed; for each host the number of distinct documents that
hold a line is counted.  Lines above the host's limit are boilerplate and are removed; a document that loses more than a
set share of its words is depleted and rejected.  With ``copies_once`` exact copies of a text count as one document, so that
a group of copies does not make its own lines look like boilerplate before a later stage has kept one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.kernels import _BYTE_CODES, _LOWER_CODES, Words, chunks, range_hash, range_sums, rolling, text_bytes, tidied
from siltrace.llm.storage import written

MIN_DOCS = 5  # a line in at most so many documents of a host is never boilerplate
MAX_SHARE = 0.05  # nor is one in at most this share of the host's documents
MAX_LOST = 0.5  # a document may lose this share of its words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = (
    "doc_id long, text_key long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, lines array<long>, line_words array<int>"
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return np.diff(sums[offsets])


def _lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of all \\n-split lines."""
    ends = np.sort(np.concatenate((2 * np.flatnonzero(buf == 10) + 1, 2 * offsets[1:])))
    end, broken = ends >> 1, ends & 1
    start = np.zeros(len(end), np.int64)
    start[1:] = end[:-1] + broken[:-1]
    text = np.cumsum(1 - broken) - (1 - broken)
    return start, end, text


def _repeats(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (text, hash) pairs: the order that groups equal ones, the groups' first places in it, and each place's group."""
    order = np.lexsort((h, text))
    t, v = text[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _measure(buf: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    n = len(offsets) - 1
    w = Words(buf, offsets)
    sums = range_sums(_BYTE_CODES[buf])
    text_hash = range_hash(sums, offsets[:-1], offsets[1:])

    codepoint = (buf & 0xC0) != 0x80
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    word_chars = _per_text(codepoint & (np.cumsum(inside[:-1], dtype=np.int8) > 0), offsets)
    n_symbols = _per_text(_SYMBOL[buf], offsets)

    s, h, text = rolling(w, 3)
    order, first, group = _repeats(text, h)
    often = np.diff(np.append(first, len(order)))[group] > 1 if len(order) else np.zeros(0, bool)
    marked = np.zeros(len(w.start) + 3, bool)
    for j in range(3):
        marked[s[order[often]] + j] = True
    n_repeat = np.bincount(w.text[marked[: len(w.start)]], minlength=n)

    start, end, line_text = _lines(buf, offsets)
    w0, w1 = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = w1 > w0
    start, end, line_text, w0, w1 = start[full], end[full], line_text[full], w0[full], w1[full]
    raw = range_hash(sums, start, end)
    order, first, group = _repeats(line_text, raw)
    n_dup = np.bincount(line_text, minlength=n) - np.bincount(line_text[order[first]], minlength=n)

    lowered = range_hash(range_sums(_LOWER_CODES[buf]), w.start, w.end)
    line = range_hash(range_sums(lowered), w0, w1)
    order, first, group = _repeats(line_text, line)
    size = np.bincount(group, weights=(w1 - w0)[order]).astype(np.int32) if len(order) else np.zeros(0, np.int32)
    per = np.concatenate(([0], np.cumsum(np.bincount(line_text[order[first]], minlength=n)))).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(per), pa.array(line[order[first]].view(np.int64)))
    line_words = pa.ListArray.from_arrays(pa.array(per), pa.array(size))
    counts = [w.count, word_chars, n_symbols, n_dup, n_repeat]
    return [pa.array(text_hash.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts], lines, line_words]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        buf, offsets = text_bytes(batch.column(1))
        for lo, hi in chunks(offsets):
            own = offsets[lo : hi + 1]
            part = batch.slice(lo, hi - lo)
            columns = _measure(buf[own[0] : own[-1]], own - own[0])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *columns], names)


def text_measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and normalised line hashes of every whole text."""
    source = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("text_key"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
    )
    return source.mapInArrow(tidied(_measured), _SCHEMA)


def frequent_lines(measures: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, copies_once: bool = False) -> DataFrame:
    """(host, line, n_docs) of the lines above their host's limit; repeated rows of one id and text are one document."""
    one = ["host", "text_hash"] if copies_once else ["host", "doc_id", "text_hash"]
    totals = measures.groupBy("host").agg(F.count_distinct(F.struct(*one)).alias("host_docs"))
    distinct = measures.select(*one, "lines").dropDuplicates(one)
    counts = distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    over = counts.filter(F.col("n_docs") > min_docs).join(totals, "host")
    return over.filter(F.col("n_docs") > F.col("host_docs") * max_share).select("host", "line", "n_docs")


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_lost: float = MAX_LOST,
    copies_once: bool = False,
) -> DataFrame:
    """One row per input row: host, text_key (a hash of the text), the base counts, base_failed, n_removed_words, removed_lines (hashes), kept.

    Null texts have no words and fail the base rules; texts are measured whole whatever their length.  A null host is a
    host of its own.  Repeated rows of one id and text are judged one by one but count as one document of their host; rows
    of one text under several ids are several documents unless ``copies_once``.  An empty table gives an empty result; other
    columns are not read.
    """
    measured = text_measures(docs, id_col=id_col, text_col=text_col, host_col=host_col)
    m = written(measured.withColumn("rid", F.monotonically_increasing_id()), "line-measures")
    frequent = frequent_lines(m, min_docs, max_share, copies_once)
    removed = (
        m.select("rid", "host", F.inline(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))))
        .join(frequent.select("host", "line"), ["host", "line"])
        .groupBy("rid")
        .agg(F.sum("words").alias("n_removed_words"), F.collect_list("line").alias("removed_lines"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.coalesce("n_removed_words", F.lit(0))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return m.join(removed, "rid", "left").select(
        "doc_id",
        "host",
        "text_key",
        *counts,
        failed.alias("base_failed"),
        lost.alias("n_removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
        (~failed & (lost <= max_lost * F.col("n_words"))).alias("kept"),
    )


def without_lines(text: str, hashes: set[int]) -> str:
    """A text without the lines whose normalised hash is in ``hashes``."""
    buf = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(buf)])
    w = Words(buf, offsets)
    lowered = range_hash(range_sums(_LOWER_CODES[buf]), w.start, w.end)
    start, end, _ = _lines(buf, offsets)
    w0, w1 = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    line = range_hash(range_sums(lowered), w0, w1).view(np.int64)
    stays = [a == b or h not in hashes for a, b, h in zip(w0, w1, line.tolist(), strict=True)]
    return "\n".join(x for x, keep in zip(text.split("\n"), stays, strict=True) if keep)


def quality_filter(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns and without their host's boilerplate lines.

    Rows are met by id, text and host, so that one text under two hosts loses the lines of each of them.  Columns may bear any names.
    """
    verdicts = quality_rules(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits).filter("kept")
    verdicts = written(verdicts.select("doc_id", "host", "text_key", "removed_lines").dropDuplicates(["doc_id", "host", "text_key"]), "verdicts")
    row = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text_col).alias("text_key"),
    )
    met = [row["text_key"] == verdicts["text_key"], row["host"] == verdicts["host"], row["doc_id"].eqNullSafe(verdicts["doc_id"])]
    joined = row.join(verdicts, met)
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, lines = batch.column(0).flatten(), batch.column(1)
            some = {i: set(x) for i, x in enumerate(lines.to_pylist()) if x}
            if some:
                texts = columns[at].to_pylist()
                for i, hashes in some.items():
                    texts[i] = without_lines(texts[i], hashes)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    return joined.select("row", "removed_lines").mapInArrow(tidied(cut), docs.schema)
