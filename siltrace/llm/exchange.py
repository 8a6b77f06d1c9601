"""Rounds of questions between batches of texts and buckets of hashes.

Texts are dealt into batches of bounded size.  In a round every batch sends its digests to buckets, one compact blob for
each bucket, having merged its own repeats first; a bucket sees all digests of its hash range and answers the batches.  No
task holds more than a batch of texts or a bucket of digests, and a hash that occurs in very many texts costs its bucket
one entry for each batch at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltrace.llm.kernels import release_memory

BATCH_BYTES = 8 << 20
MAIL = "bucket long, batch long, kind int, blob binary"
NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than all others


def pack(*arrays: np.ndarray) -> bytes:
    """64-bit integer arrays in one compressed blob; sorted or slowly changing values take few bytes."""
    parts = []
    for a in arrays:
        v = np.asarray(a).astype(np.uint64, copy=False) if np.asarray(a).dtype != np.int64 else np.asarray(a).view(np.uint64)
        d = np.diff(v, prepend=np.uint64(0))
        parts += [np.uint64(len(v)).tobytes(), np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()]
    return squeezed(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    """The uint64 arrays of :func:`pack`."""
    data, at, out = unsqueezed(blob), 0, []
    while at < len(data):
        n = int(np.frombuffer(data, np.uint64, 1, at)[0])
        planes = np.frombuffer(data, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64))
        at += 8 + 8 * n
    return out


def squeezed(data: bytes) -> bytes:
    """Compressed, but for short data, of which a large corpus makes very many."""
    return b"\0" + data if len(data) < 256 else b"\1" + zstandard.ZstdCompressor(level=1).compress(data)


def unsqueezed(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]


def mail(rows: Iterable[tuple[int, int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "batch", "kind", "blob"])


def to_buckets(bucket: np.ndarray, batch: int, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """One blob for each bucket, its entries in their given order."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    cut = np.append(at, len(order))
    return [
        (int(b), batch, kind, pack(*[x[order[i:j]] for x in arrays]))
        for b, i, j in zip(names, cut[:-1], cut[1:], strict=True)
    ]


def to_batches(batch: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """One blob for each batch that entries go back to, its entries in their given order."""
    return [(0, b, k, blob) for b, _, k, blob in to_buckets(batch, 0, kind, *arrays)]


def opened(table: pa.Table, kind: int, n: int) -> list[np.ndarray]:
    """The n arrays of all blobs of a kind, joined, and which batch each entry came from."""
    rows = [(b, unpack(x)) for k, b, x in zip(table["kind"].to_pylist(), table["batch"].to_pylist(), table["blob"].to_pylist(), strict=True) if k == kind]
    if not rows:
        return [np.zeros(0, np.uint64)] * n + [np.zeros(0, np.int64)]
    out = [np.concatenate([r[1][i] for r in rows]) for i in range(n)]
    return [*out, np.repeat([r[0] for r in rows], [len(r[1][0]) for r in rows])]


class Rounds:
    """Texts dealt into batches of about ``batch_bytes``, and how many buckets their digests take."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES, buckets_per_batch: float = 0.5):
        own = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
        self.carry = carry
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own)
        self.bytes = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        self.batches = max(1, -(-self.bytes // batch_bytes))
        self.buckets = max(12, int(self.batches * buckets_per_batch))
        self.carried = source.select("carried").schema.fields if carry else []
        # Texts of one id, or without id, may lie in several batches: only exact repeats of a row share one.
        self.texts = source.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.batches)))

    def ask(self, send: Callable[[int, pa.Table], pa.Table], answers: DataFrame | None = None) -> DataFrame:
        """Mail of ``send(batch, texts[, mail])`` for every batch."""
        return self.each(send, MAIL, answers)

    def finish(self, run: Callable, schema: str, answers: DataFrame) -> DataFrame:
        """Rows of ``run(batch, texts, mail)``, one for each text in order, with the carried columns."""
        full = T.StructType.fromDDL(schema)
        if clash := {c.lower() for c in self.carry} & {c.lower() for c in full.names}:
            raise ValueError(f"carried columns {sorted(clash)} bear names of the result's own columns")
        out = self.each(lambda b, t, m: with_carried(run(b, t, m), t), T.StructType([*full.fields, *self.carried]), answers)
        return out.select(*full.names, "carried.*") if self.carried else out

    def each(self, run: Callable, schema: str | T.StructType, answers: DataFrame | None = None) -> DataFrame:
        grouped = self.texts.groupBy("batch")
        if answers is None:
            return grouped.applyInArrow(lambda key, t: released(run(key[0].as_py(), in_order(t))), schema)
        return grouped.cogroup(answers.groupBy("batch")).applyInArrow(lambda key, t, m: released(run(key[0].as_py(), in_order(t), m)), schema)

    @staticmethod
    def answer(mails: DataFrame, reply: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return mails.groupBy("bucket").applyInArrow(lambda m: released(reply(m)), MAIL)


def released(out: pa.Table) -> pa.Table:
    release_memory()
    return out


def in_order(texts: pa.Table) -> pa.Table:
    """A batch's rows in an order that is the same in every round."""
    return texts.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def with_carried(out: pa.Table, texts: pa.Table) -> pa.Table:
    """``out`` with the carried columns of its batch, row by row."""
    return out.append_column("carried", texts["carried"]) if "carried" in texts.column_names else out


def ids_of(texts: pa.Table) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(texts["doc_id"], NO_ID).to_numpy()
