"""8-connected components of failing dies.

Each wafer's failing cells come as one row of arrays; whole Arrow batches of wafers are labelled at once by minimum
propagation with pointer jumping in numpy.  A component's label is the raster index of its first cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRIDE = 1 << 16  # more columns than any map has


def _labels(wafer: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, failing neighbours) of each cell; cells are distinct."""
    if len(x) and max(int(x.max()), int(y.max())) > _STRIDE - 3:
        raise ValueError(f"maps of more than {_STRIDE - 2} rows or columns cannot be labelled")
    place = (wafer * _STRIDE + y + 1) * _STRIDE + x + 1
    order = np.argsort(place)
    p = place[order]
    links, degree = [], np.zeros(len(p), np.int64)
    for shift in (1, _STRIDE - 1, _STRIDE, _STRIDE + 1):
        at = np.searchsorted(p, p + shift)
        hit = np.flatnonzero((at < len(p)) & (p[np.minimum(at, len(p) - 1)] == p + shift))
        links.append((hit, at[hit]))
        degree[hit] += 1
        degree[at[hit]] += 1
    a, b = (np.concatenate(z) for z in zip(*links, strict=True))
    root = np.arange(len(p))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    label, neighbours = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    label[order] = (y[order] * _STRIDE + x[order])[root]
    neighbours[order] = degree
    return label, neighbours


def label_arrays(wafers: DataFrame, id_col: str = "wafer", fails: str = "fails") -> DataFrame:
    """Adds comp and neighbours, arrays beside ``fails``: an array of structs with long x and y, a wafer's distinct failing cells."""
    kept = wafers.columns
    packed = wafers.select(*kept, F.col(f"{fails}.y").alias("_y"), F.col(f"{fails}.x").alias("_x"))
    names = [*kept, "comp", "neighbours"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, xs = batch.column(len(kept)), batch.column(len(kept) + 1)
            at = ys.offsets.to_numpy()
            wafer = np.repeat(np.arange(len(ys)), np.diff(at))
            found = _labels(wafer, ys.flatten().to_numpy(), xs.flatten().to_numpy())
            arrays = [pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(v)) for v in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names)

    schema = T.StructType([*wafers.schema.fields, *[T.StructField(c, T.ArrayType(T.LongType())) for c in names[-2:]]])
    return packed.mapInArrow(run, schema)


def label_components(fails: DataFrame, id_col: str = "wafer") -> DataFrame:
    """(id, x, y, comp, neighbours) from distinct failing cells (id, x, y)."""
    cells = F.collect_list(F.struct(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))).alias("fails")
    labelled = label_arrays(fails.groupBy(id_col).agg(cells), id_col)
    own = labelled.select(id_col, F.explode(F.arrays_zip("fails", "comp", "neighbours")).alias("c"))
    return own.select(id_col, "c.fails.x", "c.fails.y", "c.comp", "c.neighbours")
