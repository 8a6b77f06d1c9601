"""Digests of long sorted lists, fed to the hash row by row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame



def _digested(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[pa.RecordBatch]:
    current, digest, count = None, None, 0
    for batch in batches:
        keys, values = [], []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or key != current:
                if digest is not None:
                    keys.append(current)
                    values.append((count, digest.hexdigest()))
                current, digest, count = key, hashlib.sha256(value.encode()), 1
            else:
                digest.update(separator + value.encode())
                count += 1
        yield _rows(keys, values, batch.schema.field(0).type)
    if digest is not None:
        yield _rows([current], [(count, digest.hexdigest())], batch.schema.field(0).type)


def _rows(keys: list, values: list, kind: pa.DataType) -> pa.RecordBatch:
    counts, digests = zip(*values, strict=True) if values else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["key", "n", "digest"])


def joined_digests(rows: DataFrame, key: str, order: Sequence[str], value: str, separator: str = ",") -> DataFrame:
    """(key, n, digest): rows of each key, and lowercase SHA-256 of their values, sorted by ``order`` and joined.

    A key's rows are sorted by Spark, which spills them, and fed to the hash one after the other: no list of them is held
    anywhere.  The hash of a list is sequential by nature, so one task reads all rows of a key.
    """
    kind = rows.schema[key].dataType.simpleString()
    ordered = rows.repartition(key).sortWithinPartitions(key, *order).select(key, value)
    return ordered.mapInArrow(lambda batches: _digested(batches, separator.encode()), f"key {kind}, n long, digest string")
