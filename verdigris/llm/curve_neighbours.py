"""Nearest neighbours by shifted space-filling curves.

Queries are a stated part of the vectors (every row whose id EVERY divides), against all of them. Vectors are projected
to few orthogonal directions, shifted, and put in Hilbert order, for several projections and shifts; each order is
range-partitioned and cut into blocks, and a query's window is its own block and the two beside it. The windows'
candidates merge and are ranked again by their true cosines, which gives a first answer and a bar for what can better
it. Then every query looks at those blocks of the first order that can still hold something better: the distance from
its projection to a block's bounding box never exceeds the distance to any vector inside. The answer is therefore exact
where the curve leaves gaps; the closer the data lie to few dimensions, the fewer blocks are opened. Only queries
travel to blocks; every vector is sent once for an ordering, and once to its block for each QUERIES queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_keys
from .stage import cut, table
from .vectors import matrix, unit_vectors

NEIGHBOURS = 10
ORDERINGS = 3
DIMS, BITS = 8, 7
WINDOW_BLOCK = 512
SCAN_BLOCK = 16384
#: The query rows: those whose vec_id this divides.
EVERY = 50
#: So many queries look at a block together.
QUERIES = 32768


def directions(dim: int, dims: int, ordering: int) -> np.ndarray:
    """Orthonormal columns, others for each ordering."""
    q, _ = np.linalg.qr(np.random.default_rng(1000 + ordering).standard_normal((dim, min(dims, dim))))
    return q


def _keys(dim: int, orderings: int):
    views = [directions(dim, DIMS, k) for k in range(orderings)]
    shifts = [np.random.default_rng(2000 + k).random(v.shape[1]) for k, v in enumerate(views)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            if not len(x):
                continue
            for k, (view, shift) in enumerate(zip(views, shifts)):
                # Unit vectors project into [-1, 1]; spread by the usual size of a part, then shifted by up to a quarter.
                cell = (np.tanh(x @ view * np.sqrt(dim) / 2) + 1) / 2 * 0.75 + 0.25 * shift
                key = hilbert_keys(np.clip((cell * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)
                yield pa.record_batch([pa.array(np.full(len(x), k, np.int32)), pa.array(key), batch.column("vec_id"), batch.column("vector")], names=["ordering", "key", "vec_id", "vector"])

    return run


def ranked(keyed: DataFrame) -> DataFrame:
    """Adds place: the row's position in its ordering, from a range sort and the sizes of its parts."""
    keyed = cut(keyed.orderBy("ordering", "key", "vec_id").withColumn("part", F.spark_partition_id()))
    parts = keyed.groupBy("ordering", "part").agg(F.count("*").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("ordering", "part").orderBy("key", "vec_id")) - 1
    return keyed.withColumn("inside", inside).join(parts, ["ordering", "part"]).withColumn("place", F.col("before") + F.col("inside")).drop("inside", "before", "part")


def best_of(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, d_ids: np.ndarray, k: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, cosine) of the k best of data for each query that reach its bar; itself is left out."""
    rows, cols, sims = [], [], []
    small = data.astype(np.float32)
    for lo in range(0, len(queries), 512):
        part = queries[lo : lo + 512]
        rough = part.astype(np.float32) @ small.T
        floor = bar[lo : lo + 512] - 1e-5
        many = k + 1 < rough.shape[1]
        if many:
            # Only rows with more than k hits need a selection.
            hit = rough >= floor[:, None].astype(np.float32)
            full = np.flatnonzero(hit.sum(axis=1) > 2 * k)
            if full.size:
                kth = np.partition(rough[full], rough.shape[1] - k - 1, axis=1)[:, rough.shape[1] - k - 1]
                hit[full] = rough[full] >= (np.maximum(kth, floor[full]) - 1e-5)[:, None]
            i, j = np.nonzero(hit)
        else:
            i, j = np.nonzero(np.ones_like(rough, bool))
        other = q_ids[lo + i] != d_ids[j]
        i, j = i[other], j[other]
        sim = np.einsum("ij,ij->i", part[i], data[j])
        ok = sim >= floor[i]
        i, j, sim = i[ok], j[ok], np.round(sim[ok], 9)
        order = np.lexsort((d_ids[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        rows.append(i[top] + lo)
        cols.append(j[top])
        sims.append(sim[top])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)


def _boxes(view: np.ndarray):
    def run(t: pa.Table) -> pa.Table:
        p = matrix(t["vector"]) @ view
        return pa.table({"block": t["block"][:1], "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()]})

    return run


def _visits(low: np.ndarray, high: np.ndarray, view: np.ndarray):
    """A row for each block whose box is nearer than the query's k-th neighbour so far."""
    step = max((1 << 21) // max(len(low), 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"))
            bar = batch.column("bar").to_numpy(zero_copy_only=False)
            for lo in range(0, len(x), step):
                p = x[lo : lo + step] @ view
                away = np.zeros((len(p), len(low)))
                for c in range(p.shape[1]):
                    gap = np.maximum(np.maximum(low[:, c] - p[:, c : c + 1], p[:, c : c + 1] - high[:, c]), 0)
                    away += gap * gap
                # Squared distance of unit vectors: 2 - 2 cosine.
                row, block = np.nonzero(away <= (2 - 2 * bar[lo : lo + step] + 1e-9)[:, None])
                take = pa.array(row + lo)
                yield pa.record_batch([*(batch.column(c).take(take) for c in ("vec_id", "vector", "bar", "group")), pa.array(block.astype(np.int64)), pa.array(np.ones(len(row), bool))], names=["vec_id", "vector", "bar", "group", "block", "asks"])

    return run


def _scan(k: int, barred: bool = True):
    """The k best of a block's vectors for each query that looks at it."""

    def run(t: pa.Table) -> pa.Table:
        ids, x = t["vec_id"].to_numpy(), matrix(t["vector"])
        asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(d):
            return pa.table({"vec_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        i, j, sim = best_of(x[q], ids[q], x[d], ids[d], k, t["bar"].to_numpy(zero_copy_only=False)[q] if barred else np.full(len(q), -2.0))
        return pa.table({"vec_id": ids[q][i], "neighbour_id": ids[d][j], "similarity": sim})

    return run


_FOUND = "vec_id long, neighbour_id long, similarity double"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, orderings: int = ORDERINGS, every: int = EVERY, windows_only: bool = False) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): the k vectors of largest cosine for every query, itself excluded.

    Queries are the vectors whose vec_id the given number divides; all vectors answer. Equal cosines (to 9 places) rank
    by neighbour_id. Vectors of different lengths are never neighbours. Rows that unit_vectors() leaves out neither ask
    nor answer; a query with fewer than k others gets them all; an empty table, or one without queries, gives no rows.
    With windows_only the blocks beyond the windows are not opened: that is the index by itself, whose recall the tests
    measure.
    """
    vectors = cut(unit_vectors(embeddings).withColumn("query", F.col("vec_id") % every == 0))
    out = None
    for dim in sorted(r["dim"] for r in vectors.where("query").select("dim").distinct().collect()):
        mine = vectors.where(F.col("dim") == dim)
        placed = cut(ranked(mine.mapInArrow(_keys(dim, orderings), "ordering int, key long, vec_id long, vector binary")))
        placed = placed.withColumn("own", F.floor(F.col("place") / WINDOW_BLOCK))
        queries = placed.where(F.col("vec_id") % every == 0)
        asking = queries.withColumn("block", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).withColumn("asks", F.lit(True))
        near = placed.withColumnsRenamed({"own": "block"}).withColumn("asks", F.lit(False)).select("ordering", "block", "vec_id", "vector", "asks")
        near = near.union(asking.select("ordering", "block", "vec_id", "vector", "asks"))
        first = cut(_top(near.groupBy("ordering", "block").applyInArrow(_scan(k, False), _FOUND), k).drop("rank"))
        part = _top(first, k)
        if not windows_only:
            bar = first.groupBy("vec_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(-1.0)).alias("bar"))
            data = placed.where("ordering = 0").withColumn("block", F.floor(F.col("place") / SCAN_BLOCK)).select("vec_id", "vector", "block")
            view = directions(dim, DIMS, 0)
            # One box for SCAN_BLOCK vectors: 128 bytes each.
            found = data.groupBy("block").applyInArrow(_boxes(view), "block long, low array<double>, high array<double>").orderBy("block").collect()
            low, high = np.array([r["low"] for r in found]), np.array([r["high"] for r in found])
            asks = data.where(F.col("vec_id") % every == 0).drop("block").join(bar, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-1.0)))
            groups = max(-(-asks.count() // QUERIES), 1)
            asks = asks.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups).cast("long")))
            asks = asks.mapInArrow(_visits(low, high, view), "vec_id long, vector binary, bar double, group long, block long, asks boolean")
            held = data.select("vec_id", "vector", F.lit(0.0).alias("bar"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "block", F.lit(False).alias("asks"))
            part = _top(first.union(asks.unionByName(held).groupBy("block", "group").applyInArrow(_scan(k), _FOUND)), k)
        out = part if out is None else out.union(part)
    if out is None:
        out = embeddings.sparkSession.createDataFrame([], "vec_id long, neighbour_id long, similarity double, rank int")
    return out.select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", "similarity")


def op10_shifted_curve_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id 50 divides; similarity is rounded to 6 places."""
    return nearest(table(spark, sf_dir, "embeddings")).withColumn("similarity", F.round("similarity", 6))


def oracle(k: int = NEIGHBOURS, every: int = EVERY) -> str:
    return f"""
WITH v AS (SELECT vec_id, MIN(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, ROUND(list_cosine_similarity(a.e, b.e), 9) AS similarity
  FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour_id) AS rank FROM p)
SELECT vec_id, rank, neighbour_id, ROUND(similarity, 6) AS similarity FROM r WHERE rank <= {k}"""
