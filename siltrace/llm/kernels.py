"""Vectorised helpers that run inside Spark tasks on Arrow batches: text bytes, words, and hashes of ranges."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text handled at once; a longer text forms a chunk of its own

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_LOWERED = np.arange(256)
_LOWERED[ord("A") : ord("Z") + 1] += 32
_LOWER_CODES = _BYTE_CODES[_LOWERED]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            full = np.full(size, b, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, or of one text."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        yield lo, (hi := max(hi, lo + 1))
        lo = hi


def range_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums for :func:`range_hash`."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end]; equal sequences have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, or those between the bytes that ``space`` flags.

    start, end: byte positions; text: index of each word's text; count, first: by text.  hash: 64 bits of each word (none
    without ``codes``).
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, codes: np.ndarray | None = _BYTE_CODES, space: np.ndarray = _SPACE):
        n = len(offsets) - 1
        space = space[buf]
        border = np.zeros(len(buf) + 1, bool)
        border[offsets[(offsets >= 0)]] = True
        word = ~space
        prev = np.zeros(len(buf), bool)
        prev[1:] = word[:-1]
        after = np.zeros(len(buf), bool)
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~prev | border[:-1]))
        self.end = np.flatnonzero(word & (~after | border[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(n), self.count)
        self.hash = None if codes is None else range_hash(range_sums(codes[buf]), self.start, self.end)


def word_numbers(buf: np.ndarray, w: Words) -> np.ndarray:
    """A number for each word: equal ones for equal words, compared byte by byte."""
    size = w.end - w.start
    ends = np.cumsum(size)
    if not len(ends):
        return ends
    flat = buf[np.repeat(w.start - (ends - size), size) + np.arange(ends[-1])]
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, n: int) -> pa.Array:
    """Of each of n groups, which do not fall, the words [start, end) joined by one space."""
    size = end - start
    spaced = np.concatenate((group[1:] == group[:-1], [False]))[: len(size)]
    ends = np.cumsum(size + spaced)
    flat = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    place = np.ones(len(flat), bool)
    place[ends[spaced] - 1] = False
    till = np.cumsum(size)
    flat[place] = buf[np.repeat(start - (till - size), size) + np.arange(till[-1] if len(till) else 0)]
    offsets = np.concatenate(([0], ends))[np.searchsorted(group, np.arange(n + 1))].astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(flat))


def joined_words(buf: np.ndarray, w: Words, keep: np.ndarray) -> pa.Array:
    """Each text's words that ``keep`` flags, joined by one space."""
    stay = np.flatnonzero(keep)
    return _joined(buf, w.start[stay], w.end[stay], w.text[stay], len(w.count))


def joined_ranges(buf: np.ndarray, w: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words of each range [start, end), joined by one space."""
    count = end - start
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return _joined(buf, w.start[at], w.end[at], np.repeat(np.arange(len(count)), count), len(count))


def rolling(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within texts: (first word, hash, text)."""
    n = len(w.start) - k + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z
    s = np.arange(n)
    inside = w.text[:n] == w.text[k - 1 :]
    s = s[inside]
    sums = range_sums(w.hash)
    return s, range_hash(sums, s, s + k), w.text[s]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Flags of the positions below n that some interval [start, start + width) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # a C library without it keeps what it has freed
    _trim = None


def release_memory() -> None:
    """Hand freed memory back to the system: Python workers live on between tasks and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidied(run):
    """A task function over batches that releases memory after each batch."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(iter([batch]))
            del batch
            release_memory()

    return outer
