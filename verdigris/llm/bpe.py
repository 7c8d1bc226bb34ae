"""Byte-level BPE in length-bucketed padded matrices.

Texts are cut into pieces by the vocabulary's pattern; each distinct piece is encoded once. Pieces of similar length
form a padded matrix of byte tokens; in every round each row merges its leftmost pair of minimum rank, looked up in an
open-addressing hash table of token pairs, and closes the gap; rows without a pair leave the matrix. A piece of more
than LONG bytes is a row by itself and merges, besides the leftmost pair, all further ones of the same rank that would
be next in turn, so its rounds are as many as ranks occur in it, not as many as merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .stage import identified
from .textnum import U64, list_array, mix, ranges, slices, text_buffer

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces that a worker remembers between batches before it starts afresh.
REMEMBERED = 400_000
LONG = 512
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a byte-level vocabulary: pair table for encoding, byte strings for decoding."""

    def __init__(self, path: str):
        ranks = {}
        for line in Path(path).read_bytes().splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.length = np.array([len(t) for t in parts], np.int64)
        self.offset = np.append(0, np.cumsum(self.length))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(pairs, np.int64).reshape(-1, 3)
        key = (pairs[:, 0] << 32 | pairs[:, 1]) + 1
        self.bits = max(int(4 * len(key)).bit_length(), 4)
        self.keys, self.ranks = np.zeros(1 << self.bits, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        left, step = np.arange(len(key)), 0
        while left.size:
            slot = self._slot(key[left], step)
            free = self.keys[slot] == 0
            first = np.unique(slot[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[free][first]], self.ranks[slot[free][first]] = key[put], pairs[put, 2]
            left = np.setdiff1d(left, put)
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((mix(key.astype(U64)) >> U64(64 - self.bits)).astype(np.int64) + step) & ((1 << self.bits) - 1)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent ones make, or the largest integer."""
        key = (left.astype(np.int64) << 32 | right) + 1
        out = np.full(len(key), _NONE, np.int32)
        slot = self._slot(key, 0)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != 0)
            if not go.any():
                break
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, end to end, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        off = np.append(0, np.cumsum(size))
        counts = np.zeros(len(pieces), np.int64)
        where, values = [], []
        bucket = np.frexp(size.astype(float))[1]
        for b in np.unique(bucket[size > 0]):
            rows = np.flatnonzero((bucket == b) & (size > 0))
            if 1 << int(b) > LONG:
                for r in rows:
                    ids = self._merge_long(buf[off[r] : off[r + 1]])
                    counts[r] = len(ids)
                    where.append(np.array([r]))
                    values.append(ids)
                continue
            per = max((1 << 21) // (1 << int(b)), 1)
            for k in range(0, len(rows), per):
                part = rows[k : k + per]
                ids, n = self._merge(buf, off[part], size[part])
                counts[part] = n
                where.append(part)
                values.append(ids)
        start = np.append(0, np.cumsum(counts))
        out = np.zeros(start[-1], np.int32)
        for part, ids in zip(where, values):
            out[np.repeat(start[part], counts[part]) + ranges(counts[part])] = ids
        return out, counts

    def _merge(self, buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(begin), int(size.max())
        ids = np.full((n, width + 1), -1, np.int32)
        at = ranges(size)
        row = np.repeat(np.arange(n), size)
        ids[row, at] = self.byte[buf[np.repeat(begin, size) + at]]
        rank = np.full((n, width), _NONE, np.int32)
        if width > 1:
            has = np.flatnonzero(at < np.repeat(size, size) - 1)
            rank[row[has], at[has]] = self.pair_rank(ids[row[has], at[has]], ids[row[has], at[has] + 1])
        done, have, live = np.zeros((n, width), np.int32), size.copy(), np.arange(n)
        while live.size:
            low = rank.argmin(axis=1)  # the leftmost of equal ranks
            best = rank[np.arange(len(live)), low]
            over = best == _NONE
            if over.any():
                done[live[over], : ids.shape[1] - 1] = ids[over, :-1]
                ids, rank, low, best, live = ids[~over], rank[~over], low[~over], best[~over], live[~over]
                if not live.size:
                    break
                # Columns that no row fills any more go.
                most = int(have[live].max())
                ids, rank = np.ascontiguousarray(ids[:, : most + 1]), np.ascontiguousarray(rank[:, :most])
            r = np.arange(len(live))
            ids[r, low] = best
            # Close the gap behind the merged pair.
            column = np.arange(rank.shape[1])
            source = np.minimum(column + (column > low[:, None]), rank.shape[1])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), source, axis=1)
            have[live] -= 1
            left = np.flatnonzero(low > 0)
            rank[left, low[left] - 1] = self.pair_rank(ids[left, low[left] - 1], ids[left, low[left]])
            rank[r, low] = _NONE
            right = np.flatnonzero(low + 1 < have[live])
            rank[right, low[right]] = self.pair_rank(ids[right, low[right]], ids[right, low[right] + 1])
        at = ranges(have)
        return done[np.repeat(np.arange(n), have), at], have

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        ids = self.byte[piece]
        rank = self.pair_rank(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best)
            # Of overlapping pairs, as in a run of one token, every second one stays.
            head = np.append(True, np.diff(at) > 1)
            turn = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[turn % 2 == 0]
            # In turn: what lies to the left is merged already, what lies to the right isn't yet.
            left = ids[np.maximum(at - 1, 0)]
            left[1:][at[1:] - 2 == at[:-1]] = best
            right = ids[np.minimum(at + 2, len(ids) - 1)]
            made = np.full(len(at), best, np.int32)
            lower = (at > 0) & (self.pair_rank(left, made) < best) | (at + 2 < len(ids)) & (self.pair_rank(made, right) < best)
            # A merge that makes a pair of lower rank ends the round: that pair comes first.
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep[1:]] if len(keep) > 1 else rank
            place = at - np.arange(len(at))
            near = np.unique(np.concatenate([place, place - 1]))
            near = near[(near >= 0) & (near + 1 < len(ids))]
            rank[near] = self.pair_rank(ids[near], ids[near + 1])
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        n = self.length[ids]
        return self.bytes[np.repeat(self.offset[ids], n) + ranges(n)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Pieces(dict):
    """Numbers of distinct pieces in order of appearance."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    def __init__(self, path: str, pattern: str = PATTERN):
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.encoded = _Pieces(), 0
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts, end to end, and how many each has."""
        if len(self.pieces) > REMEMBERED:
            self._reset()
        find, number = self.pattern.findall, self.pieces.__getitem__
        found = [np.fromiter(map(number, find(t)), np.int64) for t in texts]
        if len(self.pieces) > self.encoded:
            new = [p.encode() for p in list(self.pieces)[self.encoded :]]
            ids, counts = self.vocabulary.encode_pieces(new)
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.append(self.start, self.start[-1] + np.cumsum(counts))
            self.encoded = len(self.pieces)
        which = np.concatenate(found) if found else np.zeros(0, np.int64)
        n = self.start[which + 1] - self.start[which]
        ids = self.ids[np.repeat(self.start[which], n) + ranges(n)]
        total = np.append(0, np.cumsum(n))
        at = np.append(0, np.cumsum([len(f) for f in found]).astype(np.int64))
        return ids, total[at[1:]] - total[at[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a worker: pieces seen by an earlier task are not encoded again."""
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            column = batch.column("text")
            _, off = text_buffer(column)
            for lo, hi in slices(off, 1 << 21):
                part = column[lo:hi]
                ids, counts = coder.encode(part.fill_null("").to_pylist())
                buf, at = text_buffer(part)
                back = coder.vocabulary.decode(ids)
                size = np.append(0, np.cumsum(coder.vocabulary.length[ids]))[np.append(0, np.cumsum(counts))]
                # Equal ends and equal bytes: every text came back as it was.
                same = np.diff(size) == np.diff(at)
                if len(back) == len(buf) and same.all():
                    wrong = np.append(0, np.cumsum(back != buf))
                    same = wrong[at[1:]] == wrong[at[:-1]]
                else:
                    same = np.array([np.array_equal(back[size[i] : size[i + 1]], buf[at[i] : at[i + 1]]) for i in range(hi - lo)])
                yield pa.record_batch([batch.column("doc_id")[lo:hi], list_array(ids, counts, pa.int32()), pa.array(counts), pa.array(same)], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return run


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip): each text's tokens, decoded again and compared byte by byte.

    path names a rank file that every executor can read. Null and empty texts have no token. Rows with a null doc_id
    are left out; repeated rows are encoded each; texts of any length are encoded whole. An empty table gives no rows.
    """
    return identified(docs).mapInArrow(_encode(path), "doc_id long, token_ids array<int>, n_tokens long, round_trip boolean")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            column = batch.column("token_ids")
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            size = np.append(0, np.cumsum(coder.length[ids]))[np.append(0, np.cumsum(counts))]
            raw = coder.decode(ids).tobytes()
            texts = [raw[a:b].decode(errors="replace") for a, b in zip(size[:-1], size[1:])]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of token lists; bytes that are no UTF-8 become U+FFFD.

    Null and empty lists are empty texts; null doc_ids and repeated rows are kept as they are. An empty table gives no
    rows.
    """
    return tokens.select("doc_id", "token_ids").mapInArrow(_decode(path), "doc_id long, text string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
