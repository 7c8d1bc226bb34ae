"""Embedding tables as unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import binary_array

SCHEMA = "vec_id long, dim int, vector binary"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column("vec_id"), batch.column("embedding")
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        holes = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.append(0, np.cumsum(lengths))
        row = np.repeat(np.arange(len(lengths)), lengths)
        square = np.bincount(row, values * values, len(lengths))
        good = (lengths > 0) & (square > 0) & np.isfinite(square) & (holes[at[1:]] == holes[at[:-1]])
        unit = values / np.sqrt(np.where(square > 0, square, 1))[row]
        kept = unit[good[row]]
        yield pa.record_batch([ids.filter(pa.array(good)), pa.array(lengths[good].astype(np.int32)), binary_array(kept.view(np.uint8), 8 * lengths[good])], names=["vec_id", "dim", "vector"])


def unit_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, vector): one unit vector, as float64 bytes, for each vec_id.

    Null vec_ids, null or empty vectors, zero vectors, and vectors with a null, NaN or infinite part are left out. Of
    several rows with one vec_id the smallest vector counts.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    one = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.mapInArrow(_unit, SCHEMA)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """n x d matrix of a binary column whose vectors have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].copy().view(np.float64).reshape(n, -1)
