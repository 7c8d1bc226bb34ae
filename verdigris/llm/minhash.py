"""MinHash near-duplicates by BagMinHash: weighted-Jaccard signatures, banding, exact verification.

A document is the multiset of its folded word shingles; a shingle's weight is its count. For every shingle, weights
are covered by the dyadic blocks [0,1), [1,2), [2,4), [4,8) ...; each block carries a Poisson process in time whose
rate is the block's width. A block that lies below the weight gives all its points. The block that holds the weight is
split in halves again and again: a point goes to either half with equal chance, one in a half that lies below the
weight counts, one in a half beyond it goes, and the half that holds the weight is split further. Every point names one
register, which keeps the earliest time it sees. A register's winner is then a
uniform point of the weighted set, so two registers agree with the probability of the weighted Jaccard similarity.
Points later than a time that fills the registers with near certainty are not made; rows with an empty register get
more time until none is empty, so the signature is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .stage import cut, identified
from .textnum import U64, binary_array, mix, prefix, ranges, signed, span, text_slices, words

SHINGLE = 2
BANDS, ROWS = 48, 4
THRESHOLD = 0.5


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its distinct shingles as (row, hash, count), sorted by row and hash. Rows of fewer words are one shingle."""
    h, _, _, at = words(buf, off)
    n = np.diff(at)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    start = np.repeat(at[:-1], many) + ranges(many)
    key = span(prefix(h), start, np.minimum(start + size, np.repeat(at[1:], many)))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.append(first, len(key)))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def below(h: np.ndarray, low: int, width: int, weight: np.ndarray) -> np.ndarray:
    """Which points of the block [low, low + width) lie below their weight: halves of the block until that is settled.

    The bits of h are the point's halvings. A weight that the whole block lies below needs none of them.
    """
    inside = weight >= low + width
    open_, base, bit = np.flatnonzero(~inside), np.full(len(h), low, np.int64), 0
    while width > 1 and open_.size:
        width >>= 1
        bit += 1
        right = (h[open_] >> U64(64 - bit)) & U64(1) == 1
        base[open_] += np.where(right, width, 0)
        under, beyond = base[open_] + width <= weight[open_], base[open_] >= weight[open_]
        inside[open_[under]] = True
        open_ = open_[~under & ~beyond]
    return inside


def bag_signatures(rows: int, row: np.ndarray, key: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """rows x m registers, each the hash of its earliest point; rows without shingles get zeros."""
    out = np.zeros((rows, m), U64)
    total = np.bincount(row, weight, rows)
    todo = total > 0
    spread = np.log(m) + 3.0
    while todo.any():
        limit = np.where(todo, spread * m / np.maximum(total, 1), 0.0)
        use = np.flatnonzero(todo[row])
        times, hashes, regs, owners = [], [], [], []
        level = 0
        while use.size:
            low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            use = use[weight[use] > low]
            r, w = row[use], weight[use]
            seed = mix(key[use] + U64((level * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64))
            t, live = np.zeros(len(use)), np.arange(len(use))
            step = 0
            while live.size:
                h = mix(seed[live] + U64((step * 0x9E3779B97F4A7C15 + 1) % 2**64))
                t[live] -= np.log(_unit(h)) / width
                live = live[t[live] <= limit[r[live]]]
                if not live.size:
                    break
                h = mix(seed[live] + U64((step * 0x9E3779B97F4A7C15 + 2) % 2**64))
                step += 1
                some = below(h, low, width, w[live])
                inside, h = live[some], mix(h[some])
                times.append(t[inside])
                hashes.append(h)
                regs.append((h & U64(0xFFFFFFFF)).astype(np.int64) * m >> 32)
                owners.append(r[inside])
            level += 1
        if times:
            t, h = np.concatenate(times), np.concatenate(hashes)
            cell = np.concatenate(owners) * m + np.concatenate(regs)
            order = np.lexsort((h, t, cell))
            cell = cell[order]
            first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
            filled = np.bincount(cell[first] // m, minlength=rows) == m
            good = first[filled[cell[first] // m]]
            out.reshape(-1)[cell[good]] = h[order[good]] | U64(1)
            todo &= ~filled
        spread *= 2
    return out


def _sketch(bands: int, rows: int, size: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column("text")):
                row, key, n = shingles(buf, off, size)
                sig = bag_signatures(hi - lo, row, key, n, m)
                band = np.zeros((hi - lo, bands), U64)
                for k in range(rows):
                    band = mix(band * U64(31) + sig[:, k::rows])
                band = mix(band + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))
                body = mix(key) * n.astype(U64)
                sums = np.zeros((2, hi - lo), U64)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                for k, v in enumerate((body, mix(body + U64(7)))):
                    c = np.append(U64(0), np.cumsum(v))
                    sums[k] = c[at[1:]] - c[at[:-1]]
                total = np.bincount(row, n, hi - lo).astype(np.int64)
                bag = mix(mix(sums[0]) + sums[1] + mix(total.astype(U64)))
                yield pa.record_batch(
                    [batch.column("doc_id")[lo:hi], batch.column("body")[lo:hi], pa.array(signed(bag)), pa.array(total), binary_array(band.view(np.uint8).reshape(-1), np.full(hi - lo, 8 * bands))],
                    names=["doc_id", "body", "bag_id", "total", "bands"],
                )

    return run


def _bags(size: int):
    """Each text's multiset, as sorted 32-bit shingle hashes with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column("text")):
                row, key, n = shingles(buf, off, size)
                small = np.empty((len(key), 2), np.uint32)
                small[:, 0], small[:, 1] = key >> U64(32), n
                yield pa.record_batch([batch.column("bag_id")[lo:hi], binary_array(small.reshape(-1).view(np.uint8), 8 * np.bincount(row, minlength=hi - lo))], names=["bag_id", "bag"])

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard of pairs of bags: (buffer of uint32 pairs, offsets in pairs)."""
    n = len(a[1]) - 1
    out = np.zeros(n)
    parts = []
    for values, off in (a, b):
        v = values.reshape(-1, 2)
        parts.append((np.repeat(np.arange(n, dtype=U64), np.diff(off)) << U64(32) | v[:, 0].astype(U64), v[:, 1].astype(np.int64), off))
    (ka, wa, oa), (kb, wb, ob) = parts
    sa, sb = (np.diff(np.append(0, np.cumsum(w))[o]) for w, o in ((wa, oa), (wb, ob)))
    at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
    hit = np.flatnonzero(kb[at] == ka) if len(kb) else np.zeros(0, np.int64)
    common = np.bincount((ka[hit] >> U64(32)).astype(np.int64), np.minimum(wa[hit], wb[at[hit]]), n)
    both = sa + sb - common
    np.divide(common, both, out=out, where=both > 0)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from .textnum import text_buffer

    for batch in batches:
        (ba, oa), (bb, ob) = (text_buffer(batch.column(c)) for c in ("bag_a", "bag_b"))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(n, max(lo + 1, int(np.searchsorted(oa + ob, (oa + ob)[lo] + (1 << 21)))))
            sim = overlap((ba[oa[lo] : oa[hi]].view(np.uint32), (oa[lo : hi + 1] - oa[lo]) // 8), (bb[ob[lo] : ob[hi]].view(np.uint32), (ob[lo : hi + 1] - ob[lo]) // 8))
            yield pa.record_batch([batch.column("a")[lo:hi], batch.column("b")[lo:hi], pa.array(sim)], names=["a", "b", "similarity"])
            lo = hi


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    left, right = bags.select(F.col("bag_id").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("bag_id").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(_verify, "a long, b long, similarity double")


def grouped(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, body, kept_doc_id, kept_body) of every text of a group that isn't the group's kept one.

    body is the hash of the text: a doc_id whose rows hold different texts is as many members of groups. Equal
    multisets are one node of the graph, whatever the number of their documents, so no row ever holds a group's ids.
    """
    docs = identified(docs).withColumn("body", F.xxhash64("text"))
    sketches = docs.mapInArrow(_sketch(bands, rows, shingle), "doc_id long, body long, bag_id long, total long, bands binary").where("total > 0")
    first = F.min(F.struct("doc_id", "body")).alias("least")
    # Both aggregates fold copies before they are shuffled: a bag of a million documents is one row of each map task.
    members = cut(sketches.groupBy("doc_id", "body", "bag_id", "total").agg(F.first("bands").alias("bands")))
    one = cut(members.groupBy("bag_id").agg(first, F.max("total").alias("total"), F.first("bands").alias("bands")))

    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("bands", i * 8 + 1, F.lit(8))))
    spots = one.select("bag_id", "total", place.alias("bucket"))
    # Buckets of one bag are most of all; they go before their rows are sorted.
    heads = spots.groupBy("bucket").agg(F.min("bag_id").alias("head"), F.max("bag_id").alias("last")).where("head < last")
    banded = cut(spots.join(heads.select("bucket", "head"), "bucket"))
    near = banded.select("bag_id").distinct()
    texts = one.join(near, "bag_id", "left_semi").select("bag_id", F.col("least.doc_id").alias("doc_id"), F.col("least.body").alias("body"))
    bags = cut(docs.join(texts, ["doc_id", "body"]).dropDuplicates(["bag_id"]).select("bag_id", "text").mapInArrow(_bags(shingle), "bag_id long, bag binary"))
    star = cut(_verified(banded.where("bag_id <> head").select(F.col("bag_id").alias("a"), F.col("head").alias("b")).distinct(), bags))

    failed = star.where(F.col("similarity") < threshold).select(F.col("a").alias("bag_id"), F.col("b").alias("head"))
    rest = banded.join(failed, ["bag_id", "head"], "left_semi").select("bucket", F.col("bag_id").alias("a"), F.col("total").alias("na"))
    more = rest.join(banded.where("bag_id <> head").select("bucket", F.col("bag_id").alias("b"), F.col("total").alias("nb")), "bucket")
    # The smaller bag over the larger one is the most that two multisets can have in common.
    more = more.where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = star.union(_verified(more, bags)).where(F.col("similarity") >= threshold).select("a", "b")
    roots = components(links, "a", "b").select(F.col("node").alias("bag_id"), "root")
    classes = cut(one.join(roots, "bag_id", "left").select("bag_id", "least", F.coalesce("root", "bag_id").alias("root")))
    kept = classes.groupBy("root").agg(F.min("least").alias("kept"))
    of = classes.join(kept, "root").select("bag_id", "kept")
    found = members.select("doc_id", "body", "bag_id").join(of, "bag_id")
    return found.select("doc_id", "body", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.body").alias("kept_body")).where("doc_id <> kept_doc_id OR body <> kept_body")


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, kept_doc_id): every document of a group of near-duplicates but its smallest doc_id.

    Two documents are linked when they share a band and the weighted Jaccard similarity of their shingle multisets is
    at least the threshold; groups are the connected components. Copies with equal multisets fold to one before
    banding. In a bucket all are compared with one member; members that fail there are then compared with all of the
    bucket that their sizes allow, so every link between members is found or already implied.

    Null and empty texts, and texts without a word, have no shingle and are never grouped. Rows with a null doc_id are
    left out. Repeated rows of one doc_id and text count as one document; different texts of one doc_id are members of
    their own groups, and what links two texts of one doc_id alone is no row. Texts of any length are used whole; ties
    go to the smallest doc_id. An empty table gives no rows.
    """
    return grouped(docs, **params).where("doc_id <> kept_doc_id").select("doc_id", "kept_doc_id").distinct()


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """documents with one text of each group: the one of the smallest doc_id, then of the smallest text hash.

    A row goes only if its own text was grouped: another text under the same doc_id stays. Rows that repeat the kept
    doc_id and text all stay, as do null, empty and wordless texts and rows with a null doc_id. An empty table stays
    empty.
    """
    gone = grouped(docs, **params).select(F.col("doc_id").alias("gone_doc_id"), F.col("body").alias("gone_body"))
    same = (docs["doc_id"].cast("long") == gone["gone_doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_body"])
    return docs.join(gone, same, "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
