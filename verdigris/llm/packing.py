"""Packing along a space-filling curve: neighbours in meaning share a training sequence.

Each document's bag of folded words is a hashed vector; a fixed random projection takes it to DIMS dimensions, where
its cell's place on the Hilbert curve is the sort key. Documents are range-sorted by that key and laid end to end; a
sequence is the next CAPACITY tokens of that line, so neighbours along the curve are packed together and every
sequence but the last is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_keys
from .stage import cut, identified
from .textnum import U64, text_slices, words

DIMS, BITS = 4, 12
CAPACITY = 4096
_SLOTS = 1 << 14


def projection(dims: int, slots: int = _SLOTS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((slots, dims)).astype(np.float32)


def document_points(h: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Projected unit-variance document vectors: each word adds its slot's row; rows without a word are at 0."""
    n = np.diff(at)
    slot = (h >> U64(64 - int(len(table)).bit_length() + 1)).astype(np.int64)
    out = np.zeros((len(n), table.shape[1]))
    full = np.flatnonzero(n > 0)
    for k in range(table.shape[1]):
        if full.size:
            out[full, k] = np.add.reduceat(table[slot, k].astype(np.float64), at[:-1][full]) / n[full]
    return out


def _cells(points: np.ndarray, bits: int) -> np.ndarray:
    """A squashing of the line to cells that is the same for any corpus."""
    return np.minimum(((np.tanh(points * 2) + 1) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def _keys(dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = projection(dims)
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column("text")):
                h, _, _, at = words(buf, off)
                key = hilbert_keys(_cells(document_points(h, at, table), bits), bits)
                yield pa.record_batch([batch.column("doc_id")[lo:hi], pa.array(key), pa.array(np.diff(at))], names=["doc_id", "curve_key", "n_tokens"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """(seq_id, position, doc_id, doc_start, n_tokens, curve_key): the pieces of documents in each training sequence.

    Tokens are folded words. A piece is tokens doc_start .. doc_start + n_tokens of its document; position is the
    piece's first token in the sequence. A document longer than what is left of a sequence goes on in the next, so no
    token is lost or repeated and all sequences but the last hold capacity tokens. Ties in the key go by doc_id.

    Null texts, empty texts and texts without a word have no token and give no piece; rows with a null doc_id are left
    out; repeated rows are packed as often as they occur. An empty table gives no rows.
    """
    keyed = identified(docs).mapInArrow(_keys(dims, bits), "doc_id long, curve_key long, n_tokens long").where("n_tokens > 0")
    keyed = cut(keyed)  # else the range sort's sampling would read the texts a second time
    keyed = keyed.orderBy("curve_key", "doc_id", "n_tokens").withColumn("part", F.spark_partition_id())
    keyed = cut(keyed)
    within = Window.partitionBy("part").orderBy("curve_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    # One row for a partition: the window over all of them is as small as the number of tasks.
    parts = keyed.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    line = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").withColumn("begin", F.col("before") + F.col("inside"))
    size = F.lit(capacity)
    line = line.withColumn("seq_id", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("n_tokens") - 1) / size))))
    low, high = F.greatest("begin", F.col("seq_id") * size), F.least(F.col("begin") + F.col("n_tokens"), (F.col("seq_id") + 1) * size)
    return line.select("seq_id", (low - F.col("seq_id") * size).alias("position"), "doc_id", (low - F.col("begin")).alias("doc_start"), (high - low).alias("n_tokens"), "curve_key")


def op4_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
