"""Suffix-array deduplication by bucket-pointer refinement, distributed over texts of any total size.

A suffix's bucket is refined from its first q bytes by the buckets of the suffixes at later offsets, until buckets are as
deep as the repeats to find.  Three steps do so without moving all suffixes:

1.  Anchors.  The initial buckets are 8-byte grams; bucket identifiers of 16 and 32 bytes are made from those of 8 and 16 bytes
    at the same and a later offset.  In every ``width``-byte string the 16-byte bucket of smallest identifier is its anchor,
    so equal strings have equal anchors at equal places.  Stretches of strings with a common anchor travel as (anchor's bucket,
    identifier of the stretch, made from the 32-byte buckets of its later offsets).
2.  First refinement.  Within an anchor's bucket, stretches are sorted on the identifiers of their later offsets.  Equal
    ones are repeats of the stretch in the smallest document; only one of each set is refined further, and only where its
    bucket holds others.
3.  Suffix array.  The bytes of those stretches are fetched and their suffixes sorted by bucket-pointer refinement: initial
    q-gram buckets, then sorting on the bucket pointers 8, 16 and ``width - 32`` bytes later, each pass reusing the pointers
    the last has updated, and touching only suffixes whose bucket still has others.  The suffixes of an anchor that very many
    stretches share are not sorted in one place: they are dealt by the identifier of their ``width`` bytes, made in the same
    way, and each such bucket is sorted by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.exchange import BATCH_BYTES, Rounds, ids_of, mail, opened, squeezed, to_batches, to_buckets, unsqueezed
from siltrace.llm.kernels import chunks, covered, mix, text_bytes

WIDTH = 50  # bytes
ANCHOR = 16
HOT_STRETCHES = 4096  # with one anchor, beyond which its suffixes are dealt by the identifiers of their whole strings
SORTED_BYTES = 1 << 20  # of stretches whose suffixes are sorted at once

_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_OUT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of strings from those of two buckets that cover them: equal ones for equal pairs."""
    return mix(a * _STEP + (b ^ (b >> np.uint64(29))))


def bucket_ids(buf: np.ndarray) -> dict[int, np.ndarray]:
    """Bucket identifiers of the 8, 16 and 32 bytes from each place on; places too near to the end have none."""
    words = np.lib.stride_tricks.sliding_window_view(buf, 8) if len(buf) >= 8 else np.zeros((0, 8), np.uint8)
    out = {8: np.ascontiguousarray(words).view("<u8").ravel()}
    for size in (8, 16):
        out[2 * size] = _joined(out[size][:-size], out[size][size:])
    return out


def string_ids(ids: dict[int, np.ndarray], start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Identifiers of strings of 32 to 128 bytes, from the 32-byte buckets at 0, 32, 64 and the last possible offset."""
    own, last = ids[32], size - 32
    out = own[start]
    for offset in (32, 64, 96):
        out = _joined(out, own[start + np.minimum(offset, last)])
    return out ^ np.asarray(size).astype(np.uint64)


def anchored_stretches(buf: np.ndarray, offsets: np.ndarray, width: int, q: int) -> tuple[np.ndarray, ...]:
    """Stretches of strings with one anchor: (first start, number of starts, anchor's bucket, id of the stretch, text)."""
    n = len(buf) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z
    ids = bucket_ids(buf)
    h = ids[q]
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h)).astype(np.uint64)
    grams, span = width - q + 1, 1
    while 2 * span <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[grams - span : grams - span + n])
    inside = np.ones(n, bool)
    for b in offsets[1:-1]:  # strings that would cross from one text to the next
        inside[max(0, b - width + 1) : b] = False
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] & ~inside[:-1])
    first = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new | ~inside), n)
    count = stop[np.searchsorted(stop, first, "right")] - first
    anchor = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # The place of the anchor in the stretch belongs to the stretch's identity.
    around = string_ids(ids, first, count + width - 1) ^ (anchor - first).astype(np.uint64) * _STEP
    text = np.searchsorted(offsets, first, "right") - 1
    return first, count, h[anchor], around, text


def deep_buckets(text: np.ndarray, room: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of ``suffixes``, refined to ``depth`` (32 to 64) bytes: equal pointers, equal strings.

    room: for each position, the bytes from there to the end of its piece of text.
    """
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(7, np.uint8))), 8)
    grams = np.ascontiguousarray(words).view(">u8").ravel()
    order = np.argsort(grams, kind="stable")
    new = np.concatenate(([True], grams[order[1:]] != grams[order[:-1]]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(order)))
    pointer = np.empty(len(text), np.int64)
    pointer[order] = np.repeat(start, size)
    shared = np.empty(len(text), bool)
    shared[order] = np.repeat(size > 1, size)
    known = 8
    for offset in (8, 16, depth - 32):
        deeper = min(known + offset, depth)
        wanted = suffixes if deeper == depth else np.arange(len(text))
        active = wanted[shared[wanted] & (room[wanted] >= deeper)]
        if not len(active):
            break
        own, later = pointer[active], pointer[active + offset]
        order = np.lexsort((later, own))
        own, later, active = own[order], later[order], active[order]
        bucket = np.concatenate(([True], own[1:] != own[:-1]))
        new = bucket | np.concatenate(([True], later[1:] != later[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(active)))
        head = np.flatnonzero(bucket)
        rank = first - np.repeat(head, np.diff(np.append(head, len(active))))[first]
        pointer[active] = np.repeat(own[first] + rank, size)
        shared[active] = np.repeat(size > 1, size)
        known = deeper
    return pointer[suffixes]


def _repeated(text: np.ndarray, size: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, end) of the spans whose strings also stand in a stretch of a smaller document."""
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(text))
    suffixes = np.flatnonzero(room >= width)
    owner = np.repeat(np.arange(len(size)), size - width + 1)
    pointer = deep_buckets(text, room, suffixes, width)
    order = np.lexsort((doc[owner], pointer))
    p, d = pointer[order], doc[owner][order]
    new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    later = np.empty(len(order), bool)
    later[order] = d > np.repeat(d[new], np.diff(np.append(new, len(p))))
    own, at = owner[later], suffixes[later] - (ends - size)[owner[later]]
    if not len(own):
        return own, at, at
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(at) != 1))))
    last = np.append(cut[1:], len(own)) - 1
    return own[cut], at[cut], at[last] + width


def suffix_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    anchor: int = ANCHOR,
    hot_stretches: int = HOT_STRETCHES,
    batch_bytes: int = BATCH_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Remove every byte in a ``width``-byte string that also starts in a text of smaller id; judged on the input.

    One row per input row: (doc_id, n_bytes, n_removed, maximal removed spans, remaining bytes), with the
    columns named in ``carry``, none of which may bear the name of a result column (ValueError).  Texts are UTF-8 bytes and
    may be cut inside a character.  batch_bytes: of text in a task; hot_stretches: of one anchor that are sorted in one place.  Null and empty texts have no bytes.  Rows of equal id never remove each other's bytes;
    null ids count as larger than all others.  Whole texts are used whatever their length; an empty table gives an empty
    result; other columns are not read.
    """
    if not 48 <= width <= 64 or anchor not in (16, 32):
        raise ValueError("width must lie between 48 and 64 bytes and the anchor have 16 or 32")
    rounds = Rounds(docs, id_col, text_col, carry, batch_bytes, buckets_per_batch=1.0)
    n_buckets = rounds.buckets

    def send(batch: int, texts: pa.Table) -> pa.Table:
        ids = ids_of(texts)
        buf, offsets = text_bytes(texts["text"])
        found = []
        for lo, hi in chunks(offsets):
            own = offsets[lo : hi + 1]
            first, count, a, b, text = anchored_stretches(buf[own[0] : own[-1]], own - own[0], width, anchor)
            found.append((a >> np.uint64(8), b >> np.uint64(16), text + lo, first - (own - own[0])[text], count))
        if not found:
            return mail([])
        a, b, row, first, count = (np.concatenate(x) for x in zip(*found, strict=True))
        # Stretches that a smaller document of this batch holds too are settled here.
        doc = ids[row]
        order = np.lexsort((doc, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(doc[order[new]], np.diff(np.append(np.flatnonzero(new), len(order))))
        settled = doc > least
        out = to_buckets((a % np.uint64(n_buckets)).astype(np.int64)[~settled], batch, 0, *[x[~settled] for x in (row, doc, first, count, a, b)])
        span = (row[settled], first[settled], first[settled] + count[settled] + width - 1)
        return mail(out + to_buckets(np.full(len(span[0]), batch % n_buckets), batch, 1, *span))

    def refine(m: pa.Table) -> pa.Table:
        row, doc, first, count, a, b, batch = opened(m, 0, 6)
        doc = doc.view(np.int64)
        order = np.lexsort((doc, b, a))
        row, doc, first, count, a, b, batch = (x[order] for x in (row, doc, first, count, a, b, batch))
        passed = [(0, x, k, y) for k, x, y in zip(m["kind"].to_pylist(), m["batch"].to_pylist(), m["blob"].to_pylist(), strict=True) if k == 1]
        if not len(a):
            return mail(passed)
        bucket = np.concatenate(([True], a[1:] != a[:-1]))
        new = bucket | np.concatenate(([True], b[1:] != b[:-1]))
        at = np.flatnonzero(new)
        least = np.repeat(doc[at], np.diff(np.append(at, len(a))))
        later = doc > least
        head = np.flatnonzero(bucket)
        size = np.diff(np.append(head, len(a)))
        several = np.repeat(np.maximum.reduceat(least, head) != np.minimum.reduceat(least, head), size)
        ask = ~later & several
        hot = ask & np.repeat(np.add.reduceat(ask.astype(np.int64), head) > hot_stretches, size)
        ask &= ~hot
        out = to_batches(batch[later], 1, row[later], first[later], first[later] + count[later] + np.uint64(width - 1))
        out += to_batches(batch[ask], 2, row[ask], first[ask], count[ask], a[ask])
        out += to_batches(batch[hot], 5, row[hot], first[hot], count[hot])
        return mail(passed + out)

    def fetch(batch: int, texts: pa.Table, m: pa.Table) -> pa.Table:
        row, first, count, a, _ = opened(m, 2, 4)
        out = [(batch % n_buckets, batch, k, y) for k, y in zip(m["kind"].to_pylist(), m["blob"].to_pylist(), strict=True) if k == 1]
        if len(row):
            ids = ids_of(texts)
            buf, offsets = text_bytes(texts["text"])
            row, first, count = (x.astype(np.int64) for x in (row, first, count))
            order = np.lexsort((first, row))
            row, first, count, a = row[order], first[order], count[order], a[order]
            shard = (a % np.uint64(n_buckets)).astype(np.int64)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                size = count[own] + width - 1
                start = offsets[row[own]] + first[own]
                ends = np.cumsum(size)
                data = buf[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
                head = to_buckets(np.full(len(own), s), batch, 3, row[own], ids[row[own]], first[own], count[own], a[own])
                out += head + [(s, batch, 4, squeezed(data.tobytes()))]
        return mail(out + dealt_by_string(batch, texts, *opened(m, 5, 3)[:3]))

    def dealt_by_string(batch: int, texts: pa.Table, row: np.ndarray, first: np.ndarray, count: np.ndarray) -> list:
        """The strings of hot anchors: settled by this batch's smaller documents, or on their way to the bucket of their identifier."""
        if not len(row):
            return []
        buf, offsets = text_bytes(texts["text"])
        docs_, out = ids_of(texts), [[], [], [], []]
        for lo, hi in chunks(np.concatenate(([0], np.cumsum(count.astype(np.int64) + (width - 1))))):
            r, f, c = (x[lo:hi].astype(np.int64) for x in (row, first, count))
            size = c + width - 1
            ends = np.cumsum(size)
            piece = buf[np.repeat(offsets[r] + f - (ends - size), size) + np.arange(ends[-1])]
            within = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            start = np.repeat(ends - size, c) + within
            for store, x in zip(out, (string_ids(bucket_ids(piece), start, width), docs_[np.repeat(r, c)], np.repeat(r, c), np.repeat(f, c) + within), strict=True):
                store.append(x)
        name, doc, r, at = (np.concatenate(x) for x in out)
        order = np.lexsort((at, r, doc, name))
        name, doc, r, at = name[order], doc[order], r[order], at[order]
        new = np.concatenate(([True], name[1:] != name[:-1]))
        settled = doc > doc[new][np.cumsum(new) - 1]
        ways = (name[~settled] >> np.uint64(8)) % np.uint64(n_buckets)
        return to_buckets(ways.astype(np.int64), batch, 6, name[~settled], doc[~settled], r[~settled], at[~settled]) + to_buckets(
            np.full(int(settled.sum()), batch % n_buckets), batch, 1, r[settled], at[settled], at[settled] + width
        )

    def sort(m: pa.Table) -> pa.Table:
        kinds, batches, blobs = m["kind"].to_pylist(), m["batch"].to_pylist(), m["blob"].to_pylist()
        passed = [(0, x, k, y) for k, x, y in zip(kinds, batches, blobs, strict=True) if k == 1]
        data = {x: y for k, x, y in zip(kinds, batches, blobs, strict=True) if k == 4}
        name, doc, row, at, batch = opened(m, 6, 4)
        if len(name):
            order = np.lexsort((doc.view(np.int64), name))
            name, doc, row, at, batch = (x[order] for x in (name, doc.view(np.int64), row, at, batch))
            new = np.concatenate(([True], name[1:] != name[:-1]))
            later = doc > doc[new][np.cumsum(new) - 1]
            passed += to_batches(batch[later], 1, row[later], at[later], at[later] + np.uint64(width))
        row, doc, first, count, anchor_id, batch = opened(m, 3, 5)
        if not len(row):
            return mail(passed)
        # Kind 3 is one blob for each batch, joined in the order of the mail.
        text = np.concatenate([np.frombuffer(unsqueezed(data[x]), np.uint8) for k, x in zip(kinds, batches, strict=True) if k == 3])
        row, doc, first, count = (x.astype(np.int64) for x in (row, doc, first, count))
        size = count + width - 1
        start = np.cumsum(size) - size
        # Stretches with one anchor are sorted together; others need not be, so that the arrays stay small.
        shares = -(-len(text) // SORTED_BYTES)
        share = (anchor_id // np.uint64(n_buckets) % np.uint64(shares)).astype(np.int64)
        out = passed
        for k in range(shares):
            own = np.flatnonzero(share == k)
            if len(own):
                piece = text[np.repeat(start[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(size[own].sum())]
                i, a, b = _repeated(piece, size[own], doc[own], width)
                i = own[i]
                out += to_batches(batch[i], 1, row[i], first[i] + a, first[i] + b)
        return mail(out)

    def remove(_batch: int, texts: pa.Table, m: pa.Table) -> pa.Table:
        buf, offsets = text_bytes(texts["text"])
        row, start, stop, _ = opened(m, 1, 3)
        base = offsets[row.astype(np.int64)]
        gone = covered(len(buf), base + start.astype(np.int64), (stop - start).astype(np.int64))
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        flags = gone.astype(np.int8)
        begins = np.flatnonzero((flags > 0) & (np.concatenate(([0], flags[:-1])) == 0) | gone & edge[:-1])
        stops = np.flatnonzero((flags > 0) & (np.concatenate((flags[1:], [0])) == 0) | gone & edge[1:]) + 1
        per = np.searchsorted(begins, offsets)
        kept_at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
        flat = buf[~gone].tobytes()
        out: list[list] = [[], [], [], []]
        for i in range(texts.num_rows):
            o, a, b = int(offsets[i]), per[i], per[i + 1]
            out[0].append(int(offsets[i + 1]) - o)
            out[1].append(int(offsets[i + 1]) - o - int(kept_at[i + 1] - kept_at[i]))
            out[2].append([{"start": x - o, "end": y - o} for x, y in zip(begins[a:b].tolist(), stops[a:b].tolist(), strict=True)])
            out[3].append(flat[kept_at[i] : kept_at[i + 1]])
        columns = [texts["doc_id"], *[pa.array(x, t) for x, t in zip(out, _OUT_ARROW.types[1:], strict=True)]]
        return pa.table(columns, schema=_OUT_ARROW)

    first_round = rounds.answer(rounds.ask(send), refine)
    second_round = rounds.answer(rounds.ask(fetch, first_round), sort)
    return rounds.finish(remove, _OUT, second_round)


def suffix_digests(deduped: DataFrame) -> DataFrame:
    return deduped.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
