"""Sharding by extendible hashing.

The directory is a binary trie over the leading bits of a document's hash. It starts as one bucket; a bucket whose
documents exceed the byte limit splits on its next bit, and no other does, until every bucket fits. A bucket is then a
shard: its depth is the number of bits that name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import cut, identified

SHARD_BYTES = 64 << 20
HASH_BITS = 60
#: Bits below which one task builds a part of the directory.
_GROUP_BITS = 14


def split_buckets(key: np.ndarray, size: np.ndarray, limit: int, depth: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Depth of the bucket of each of the sorted keys, and the bucket's bytes, from one bucket of the given depth.

    Keys have HASH_BITS bits; no bucket goes deeper than most.
    """
    total = np.append(0, np.cumsum(size))
    depths, sums = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    lo, hi = np.array([0]), np.array([len(key)])
    while len(lo):
        held = total[hi] - total[lo]
        leaf = (held <= limit) | (depth >= most)
        n = (hi - lo)[leaf]
        inside = np.repeat(lo[leaf], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        depths[inside], sums[inside] = depth, np.repeat(held[leaf], n)
        lo, hi = lo[~leaf], hi[~leaf]
        if not len(lo):
            break
        shift = HASH_BITS - depth - 1
        middle = np.searchsorted(key, ((key[lo] >> shift) | 1) << shift)
        middle = np.clip(middle, lo, hi)
        lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
        some = hi > lo
        lo, hi = lo[some], hi[some]
        depth += 1
    return depths, sums


def _directory(limit: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        key, size = table["cell"].to_numpy(), table["bytes"].to_numpy()
        depth = int(table["from_depth"][0].as_py())
        depths, sums = split_buckets(key, size, limit, depth, most)
        return pa.table({"cell": key, "depth": pa.array(depths, pa.int32()), "shard_bytes": sums})

    return run


def sharded(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, shard, depth, n_bytes, shard_bytes): the shard of each document; shard names the bucket's bits.

    n_bytes is the text in UTF-8, 0 for null and empty texts. The hash is that of doc_id alone, so repeated rows share
    a shard. A bucket that still exceeds the limit when all HASH_BITS bits are used (one doc_id whose rows are larger
    than the limit together) stays as one shard, with shard_bytes above the limit. Rows with a null doc_id are left
    out. An empty table gives no rows.
    """
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = cut(identified(docs).select("doc_id", hashed.alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    # Cells of about an eighth of a shard: the directory is built from their sums, not from documents.
    fine = min(int(max(total // max(limit, 1), 1)).bit_length() + 3, HASH_BITS)
    top = max(fine - _GROUP_BITS, 0)
    cell = lambda bits: F.shiftleft(F.shiftright("hash", HASH_BITS - bits), HASH_BITS - bits)
    cells = cut(rows.groupBy(cell(fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes")))

    # Buckets above the groups' depth: as many as groups, so their sums fit the driver.
    group = F.shiftright("cell", HASH_BITS - top) if top else F.lit(0).cast("long")
    cells = cells.withColumn("group", group)
    shallow: dict[int, tuple[int, int]] = {}
    if top:
        sums = cells.groupBy("group").agg(F.sum("bytes").alias("bytes")).orderBy("group").collect()
        key, size = np.array([r["group"] << (HASH_BITS - top) for r in sums]), np.array([r["bytes"] for r in sums])
        depths, held = split_buckets(key, size, limit, 0, top)
        shallow = {r["group"]: (int(d), int(s)) for r, d, s in zip(sums, depths, held) if d < top}
    deep = cells.where(~F.col("group").isin(list(shallow))) if shallow else cells
    found = deep.withColumn("from_depth", F.lit(top)).groupBy("group").applyInArrow(_directory(limit, fine), "cell long, depth int, shard_bytes long")
    found = cut(found)
    if shallow:
        spark = docs.sparkSession
        known = spark.createDataFrame([(g, d, s) for g, (d, s) in shallow.items()], "group long, depth int, shard_bytes long")
        found = found.union(cells.join(known, "group").select("cell", "depth", "shard_bytes"))

    # Cells that exceed the limit by themselves go on, by whole hashes.
    over = found.where((F.col("depth") == fine) & (F.col("shard_bytes") > limit)).select("cell")
    placed = rows.withColumn("cell", cell(fine))
    more = placed.join(over, "cell").groupBy(F.col("cell").alias("group"), F.col("hash").alias("cell")).agg(F.sum("n_bytes").alias("bytes")).withColumn("from_depth", F.lit(fine))
    more = more.groupBy("group").applyInArrow(_directory(limit, HASH_BITS), "cell long, depth int, shard_bytes long").select(F.col("cell").alias("hash"), F.col("depth").alias("deep_depth"), F.col("shard_bytes").alias("deep_bytes"))
    out = placed.join(found, "cell").join(more, "hash", "left")
    depth = F.coalesce("deep_depth", "depth")
    name = F.expr(f"substring(lpad(bin(hash), {HASH_BITS}, '0'), 1, depth)")
    return out.withColumns({"depth": depth, "shard_bytes": F.coalesce("deep_bytes", "shard_bytes")}).select("doc_id", name.alias("shard"), F.col("depth").cast("long").alias("depth"), "n_bytes", "shard_bytes")


def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A limit that even the smallest tables exceed many times over.
SMALL_SHARD_BYTES = 64 << 10


def small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with SMALL_SHARD_BYTES: there are many splits in any of the tables."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), SMALL_SHARD_BYTES)


def oracle(limit: int = SHARD_BYTES) -> str:
    """A document's shard is the shortest prefix of its hash whose documents fit the limit together."""
    return f"""
WITH h AS (
  SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {HASH_BITS // 4}))::BIGINT AS hash,
         COALESCE(strlen(text), 0)::BIGINT AS n_bytes
  FROM documents WHERE doc_id IS NOT NULL),
levels AS (
  SELECT d, hash >> ({HASH_BITS} - d) AS p, SUM(n_bytes)::BIGINT AS s
  FROM h, (SELECT unnest(range(0, {HASH_BITS + 1})) AS d) GROUP BY ALL),
fits AS (SELECT * FROM levels WHERE s <= {limit} OR d = {HASH_BITS}),
leaf AS (
  SELECT h.hash, MIN(d) AS depth, arg_min(s, d) AS shard_bytes
  FROM (SELECT DISTINCT hash FROM h) h JOIN fits ON fits.p = h.hash >> ({HASH_BITS} - fits.d) GROUP BY h.hash)
SELECT doc_id, substr(lpad(bin(hash), {HASH_BITS}, '0'), 1, depth::INT) AS shard, depth::BIGINT AS depth, n_bytes, shard_bytes
FROM h JOIN leaf USING (hash)"""
