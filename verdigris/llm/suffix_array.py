"""Suffix-array deduplication: passages of at least MIN_WORDS words that occur in two or more documents.

Every window of MIN_WORDS words is owned by its minimizer, the leftmost of its smallest-hash k-grams, so all
occurrences of a repeated window meet under one k-gram, in one partition. Minimizers whose documents are all the same
cannot repeat across documents and drop out; occurrences whose whole neighbourhood (all windows owned) is equal fold to
one before they are shuffled. What remains is cut out of the texts, and each partition builds a suffix array over its neighbourhoods by
two-stage sorting: only suffixes smaller than their successors are sorted directly; the others are induced by scanning
the buckets from left to right. Common prefixes of adjacent suffixes then give the repeated windows.

A minimizer with more neighbourhoods than one array holds is not sorted in one task: its windows fold by their hashes,
which gives the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import cut, identified, rows_with_id
from .textnum import U64, binary_array, fold, mix, prefix, ranges, signed, span, text_buffer, text_slices, words

MIN_WORDS = 50
GRAM = 12
#: Symbols of one suffix array; neighbourhoods of one minimizer are never parted, and beyond so many it is done by hashes.
SYMBOLS = 400_000


def minimizers(h: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one minimizer: row, its k-gram's hash, neighbourhood hash, first window, windows.

    h holds the word hashes of all rows, at the rows' bounds in it; window starts are counted from the row's start.
    """
    pre = prefix(h)
    grams = max(len(h) - gram + 1, 0)
    if not grams:
        return tuple(np.zeros(0, k) for k in (np.int64, U64, U64, np.int64, np.int64))
    p = np.arange(grams)
    hashed = span(pre, p, p + gram)
    key = (hashed >> U64(26) << U64(26)) | p.astype(U64)  # the place breaks ties to the left
    width, reach, low = size - gram + 1, 1, key
    while reach * 2 <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    n = np.diff(at)
    windows = np.maximum(n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), windows)
    start = np.repeat(at[:-1], windows) + ranges(windows)
    place = (low[start] & U64((1 << 26) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))) if len(start) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(start)))
    row, begin = row[first], start[first]
    near = span(pre, begin, begin + count - 1 + size)
    # The minimizer's place in the neighbourhood is part of what makes two of them equal.
    near = mix(near + (place[first] - begin).astype(U64) * U64(0x9E3779B97F4A7C15) + count.astype(U64))
    return row, hashed[place[first]], near, begin - at[:-1][row], count


def _occurrences(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column("doc_id"), batch.column("body")
            for lo, hi, buf, off in text_slices(batch.column("text")):
                h, _, _, at = words(buf, off)
                row, gram_hash, near, begin, count = minimizers(h, at, size, gram)
                take = pa.array(row + lo)
                yield pa.record_batch([pa.array(signed(gram_hash)), pa.array(signed(near)), ids.take(take), bodies.take(take), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))], names=["gram", "near", "doc_id", "body", "start", "windows"])

    return run


def _cut_out(size: int):
    """Word hashes of the wanted neighbourhoods of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            bounds = wanted.offsets.to_numpy()
            flat = {f.name: wanted.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(wanted.type.value_type)}
            for lo, hi, buf, off in text_slices(batch.column("text")):
                h, _, _, at = words(buf, off)
                use = np.arange(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                start, count = flat["start"][use].astype(np.int64), flat["windows"][use].astype(np.int64)
                length = count - 1 + size
                inside = np.repeat(at[row] + start, length) + ranges(length)
                small = (h[inside] >> U64(32)).astype(np.uint32)
                yield pa.record_batch([*(pa.array(flat[c][use], pa.int64()) for c in ("gram", "near", "least", "most")), pa.array(count.astype(np.int32)), binary_array(small.view(np.uint8), 4 * length)], names=["gram", "near", "least", "most", "windows", "words"])

    return run


def _hashed_windows(size: int):
    """Each window of the wanted neighbourhoods: its hash, its document, and which window of which neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            bounds = wanted.offsets.to_numpy()
            flat = {f.name: wanted.values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(wanted.type.value_type)}
            for lo, hi, buf, off in text_slices(batch.column("text")):
                h, _, _, at = words(buf, off)
                use = np.arange(bounds[lo], bounds[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
                count = flat["windows"][use].astype(np.int64)
                offset = ranges(count)
                begin = np.repeat(at[row] + flat["start"][use], count) + offset
                which = np.repeat(use, count)
                yield pa.record_batch([pa.array(signed(span(prefix(h), begin, begin + size))), *(pa.array(flat[c][which], pa.int64()) for c in ("gram", "near", "least", "most")), pa.array(offset.astype(np.int32))], names=["window", "gram", "near", "least", "most", "bit"])

    return run


def two_stage(text: np.ndarray) -> np.ndarray:
    """Suffix array of positive symbols with zeros as ends, the last one included; equal suffixes keep no set order.

    Suffixes smaller than their successor are sorted directly, a few symbols a round and tied ones only; a scan of the
    buckets from left to right then places every other suffix behind those that it precedes.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + (0 if (text == 0).any() else 1)
    after = np.append(rank[1:], 0)
    differs = np.append(np.flatnonzero(rank != after), n - 1)
    following = differs[np.minimum(np.searchsorted(differs, np.arange(n)), len(differs) - 1)]
    small = rank[following] < after[following]
    small[rank == 0] = True  # ends are not compared further
    # Direct sort: symbols beyond an end read as 0, which is below all.
    direct = np.flatnonzero(small & (rank > 0))
    left = np.flatnonzero(rank == 0)
    stop = np.append(left, n)[np.searchsorted(left, direct)]
    bits = max(int(rank.max()).bit_length(), 1)
    order, group = np.arange(len(direct)), np.zeros(len(direct), np.int64)
    tied, depth = np.arange(len(direct)), 0
    while tied.size:
        group_bits = max(int(group[tied].max()).bit_length(), 1)
        take = max((63 - group_bits) // bits, 1)
        key = group[tied].copy()
        member = order[tied]
        for k in range(take):
            where = direct[member] + depth + k
            key = (key << bits) | np.where(where < stop[member], rank[np.minimum(where, n - 1)], 0)
        depth += take
        by = np.argsort(key, kind="stable")
        key, member = key[by], member[by]
        order[tied] = member
        new = np.append(True, key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        group[tied] = tied[head]
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        ended = direct[member] + depth >= stop[member]
        tied = tied[(np.repeat(size, size) > 1) & ~ended]
    counts = np.bincount(rank, minlength=int(rank.max()) + 1)
    bucket = np.append(0, np.cumsum(counts))
    smalls = np.bincount(rank[direct], minlength=len(counts))
    smalls[0] = counts[0]
    sa = np.full(n, -1, np.int64)
    sa[: len(left)] = left
    seq = direct[order]
    c = rank[seq]
    sa[bucket[c + 1] - np.repeat(smalls, np.where(np.arange(len(counts)) == 0, 0, smalls)) + ranges(np.where(np.arange(len(counts)) == 0, 0, smalls))] = seq
    # Induction: the scan meets every larger suffix's successor before the suffix's own bucket.
    out, head, symbol = sa.tolist(), bucket[:-1].tolist(), rank.tolist()
    larger = (~small).tolist()
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and larger[j]:
            s = symbol[j]
            out[head[s]] = j
            head[s] += 1
    return np.array(out, np.int64)


def common_prefixes(pre: np.ndarray, room: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix lengths of adjacent suffixes, up to the limit, within the room to each one's end."""
    a, b = sa[:-1], sa[1:]
    most = np.minimum(np.minimum(room[a], room[b]), limit)
    got = np.zeros(len(a), np.int64)
    step = 1 << max(int(limit).bit_length() - 1, 0)
    while step:
        more = got + step
        can = np.flatnonzero(more <= most)
        same = can[span(pre, a[can], a[can] + more[can]) == span(pre, b[can], b[can] + more[can])]
        got[same] += step
        step >>= 1
    return got


def repeated_windows(lengths: np.ndarray, symbols: np.ndarray, windows: np.ndarray, least: np.ndarray, most: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbourhood, window, first document) of the windows that occur in two or more documents.

    Neighbourhood i has lengths[i] symbols and windows[i] starts; its occurrences span the documents least[i]..most[i].
    """
    n = int(lengths.sum()) + len(lengths)
    text = np.zeros(n, np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    text[np.repeat(begin, lengths) + ranges(lengths)] = symbols.astype(np.int64) + 1
    sa = two_stage(text)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    offset = np.arange(n) - begin[owner]
    sa = sa[offset[sa] < windows[owner[sa]]]
    room = lengths[owner] - offset
    lcp = common_prefixes(prefix(text.astype(U64)), room, sa, size)
    run = np.cumsum(np.append(False, lcp < size)) if len(sa) else np.zeros(0, np.int64)
    if not len(sa):
        return (np.zeros(0, np.int64),) * 3
    head = np.flatnonzero(np.append(True, lcp < size))
    who = owner[sa]
    low, high = np.minimum.reduceat(least[who], head), np.maximum.reduceat(most[who], head)
    hit = np.flatnonzero((low < high)[run])
    return who[hit], offset[sa[hit]], low[run[hit]]


def _arrays(size: int):
    def solve(group: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        gram, near, least, most, windows, length, data = (np.concatenate(x) for x in zip(*group))
        who, offset, first = repeated_windows(length, data, windows, least, most, size)
        # One row for a neighbourhood and first document: a bit for each window.
        order = np.lexsort((offset, first, who))
        who, offset, first = who[order], offset[order], first[order]
        head = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (first[1:] != first[:-1]))) if len(who) else np.zeros(0, np.int64)
        mask = np.bitwise_or.reduceat(np.int64(1) << offset, head) if len(who) else np.zeros(0, np.int64)
        return pa.record_batch([pa.array(gram[who[head]]), pa.array(near[who[head]]), pa.array(first[head]), pa.array(mask)], names=["gram", "near", "first_doc_id", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimizer; arrays end where one ends."""
        group: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = text_buffer(batch.column("words"))
            cols = [batch.column(c).to_numpy() for c in ("gram", "near", "least", "most")] + [batch.column("windows").to_numpy().astype(np.int64), np.diff(off) // 4]
            gram, data, off = cols[0], buf.view(np.uint32), off // 4
            lo, n = 0, batch.num_rows
            edge = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, n)
            if group and group[-1][0][-1] != gram[0] and held >= SYMBOLS:
                yield solve(group)
                group, held = [], 0
            for hi in edge:
                if off[hi] - off[lo] + held >= SYMBOLS and hi < n:
                    group.append((*(c[lo:hi] for c in cols), data[off[lo] : off[hi]].copy()))
                    yield solve(group)
                    group, held, lo = [], 0, hi
            if lo < n:
                group.append((*(c[lo:n] for c in cols), data[off[lo] : off[n]].copy()))
                held += int(off[n] - off[lo])
        if group:
            yield solve(group)

    return run


def _intervals(size: int):
    """Word ranges that the windows of each occurrence cover: one for each run of window bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, start = batch.column("mask").to_numpy(), batch.column("start").to_numpy().astype(np.int64)
            bits = (mask[:, None] >> np.arange(63)) & 1
            edge = np.diff(np.pad(bits, ((0, 0), (1, 1))), axis=1)
            row, low = np.nonzero(edge == 1)
            _, high = np.nonzero(edge == -1)
            take = pa.array(row)
            yield pa.record_batch([*(batch.column(c).take(take) for c in ("doc_id", "body", "first_doc_id")), pa.array((start[row] + low).astype(np.int32)), pa.array((start[row] + high - 1 + size).astype(np.int32))], names=["doc_id", "body", "first_doc_id", "start_word", "end_word"])

    return run


def _wanted(docs: DataFrame, near: DataFrame) -> DataFrame:
    """The text that stands for each neighbourhood, with what to take out of it."""
    rows = near.select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.body").alias("body"), F.struct("gram", "near", "least", "most", F.col("rep.start").alias("start"), F.col("rep.windows").alias("windows")).alias("w"))
    texts = docs.join(rows.groupBy("doc_id", "body").agg(F.collect_list("w").alias("wanted")), ["doc_id", "body"])
    return texts.dropDuplicates(["doc_id", "body"]).select("text", "wanted")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, body, first_doc_id, start_word, end_word): repeated_passages() by doc_id and hash of the text."""
    docs = identified(docs).withColumn("body", F.xxhash64("text"))
    found = docs.mapInArrow(_occurrences(min_words, gram), "gram long, near long, doc_id long, body long, start int, windows int")
    # Sums by minimizer and by neighbourhood are partly made before the shuffle: a hot one is a row of each map task.
    grams = found.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("near") < F.max("near")).alias("other")).where("low < high")
    found = cut(found.join(grams.drop("high"), "gram"))
    near = found.where("other").groupBy("gram", "near").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min(F.struct("doc_id", "body", "start", "windows")).alias("rep"))
    near = cut(near)
    held = near.groupBy("gram").agg(F.sum(F.col("rep.windows") + (min_words - 1)).alias("held"))
    hot = held.where(F.col("held") > symbols).select("gram")

    # Neighbourhoods that are the only one of their minimizer repeat as a whole, without a sort.
    whole = found.where("NOT other").select("doc_id", "body", F.col("low").alias("first_doc_id"), "start", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    pieces = _wanted(docs, near.join(hot, "gram", "left_anti")).mapInArrow(_cut_out(min_words), "gram long, near long, least long, most long, windows int, words binary")
    masks = pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(_arrays(min_words), "gram long, near long, first_doc_id long, mask long")
    windows = cut(_wanted(docs, near.join(hot, "gram", "left_semi")).mapInArrow(_hashed_windows(min_words), "window long, gram long, near long, least long, most long, bit int"))
    shared = windows.groupBy("window").agg(F.min("least").alias("first_doc_id"), F.max("most").alias("last")).where("first_doc_id < last").drop("last")
    more = windows.join(shared, "window").groupBy("gram", "near", "first_doc_id").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    parts = found.where("other").select("gram", "near", "doc_id", "body", "start").join(masks.union(more), ["gram", "near"]).select("doc_id", "body", "first_doc_id", "start", "mask")
    covered = whole.union(parts).mapInArrow(_intervals(min_words), "doc_id long, body long, first_doc_id long, start_word int, end_word int")
    return merged(covered, ["doc_id", "body", "first_doc_id"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, first_doc_id, start_word, end_word, n_words) of passages that several documents share.

    A passage is a maximal word range every min_words-window of which occurs in another document too and for which the
    smallest such doc_id, first_doc_id, is the same; the range of the first document itself is also given. Words are
    those of textnum.words(). min_words - gram must stay below 63.

    Null, empty and shorter texts hold no passage. Repeats inside one document alone are no repeats across documents,
    and neither are repeated rows of one doc_id; where rows of one doc_id differ in text, the ranges of each are given.
    Rows with a null doc_id are left out. An empty table gives no rows.
    """
    return passages(docs, min_words, gram, symbols).drop("body").distinct().withColumn("n_words", F.col("end_word") - F.col("start_word"))


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching [start_word, end_word) ranges of the same keys become one."""
    order = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") <= F.col("reach"), 0).otherwise(1)).over(order)
    spans = spans.withColumn("reach", reach).withColumn("island", island)
    return spans.groupBy(*keys, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the given word ranges; white space around what goes is kept once."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        texts, stays = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if not spans[i] or not text:
                texts.append(text)
                stays.append(True)
                continue
            raw = text.encode()
            buf, off = text_buffer(pa.array([text]))
            _, start, end, _ = words(buf, off)
            keep, at = [], 0
            for s in sorted(spans[i], key=lambda x: x["start_word"]):
                keep.append(raw[at : start[s["start_word"]]])
                at = end[s["end_word"] - 1]
            texts.append(b"".join([*keep, raw[at:]]).decode(errors="replace").strip())
            stays.append(bool(fold(np.frombuffer(texts[-1].encode(), np.uint8)).any()))
        names = [c for c in batch.schema.names if c != "spans"]
        new = pa.array(texts, pa.string())
        columns = [new if c == "text" else batch.column(c) for c in names]
        if "n_chars" in names:
            at = names.index("n_chars")
            columns[at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[at].type)
        yield pa.record_batch(columns, names=names).filter(pa.array(stays, pa.bool_()))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, symbols: int = SYMBOLS) -> DataFrame:
    """documents with every repeated passage cut out of all documents but the first that holds it; n_chars follows.

    Documents without a repeat keep their text to the byte; documents whose last word is cut go. Rows that repeat a
    doc_id and text are cut alike; another text under the same doc_id loses its own passages only. Null and empty texts
    and rows with a null doc_id stay as they are; columns that documents doesn't have are dropped. An empty table stays
    empty.
    """
    docs = rows_with_id(docs)
    spans = merged(passages(docs, min_words, gram, symbols).where("doc_id <> first_doc_id").select("doc_id", "body", "start_word", "end_word"), ["doc_id", "body"])
    spans = spans.groupBy(F.col("doc_id").alias("span_doc_id"), F.col("body").alias("span_body")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    own = (docs["doc_id"].cast("long") == spans["span_doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == spans["span_body"])
    joined = docs.join(spans, own, "left").select(*docs.columns, "spans")
    return joined.mapInArrow(_remove, docs.schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
