"""Vectorised text primitives over Arrow batches.

Spark hands a string column to Python as one byte buffer with offsets; the functions here work on that buffer with
numpy, so the cost of a document is a few nanoseconds a byte and no Python object is made per word. Nulls read as
empty texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INV_BASE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; span() turns two of them into the hash of a range."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values.astype(U64) * powers(BASE, len(values)), out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the range lies."""
    return mix((pre[end] - pre[start]) * powers(INV_BASE, len(pre))[start])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, one row at least: bounds the memory of the numpy temporaries."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each slice of a string column."""
    buf, off = text_buffer(column)
    for lo, hi in slices(off, limit):
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


#: Characters that are words by themselves: Han, with its extensions, and kana.
_SINGLE = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]
_TABLED = 0x20000


@lru_cache(maxsize=1)
def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below _TABLED: 0 no word, 1 part of a word, 2 a word by itself; and its lower case.

    Letters, marks and numbers make words. A lower case that takes another number of bytes is not used.
    """
    kind, lower = np.zeros(_TABLED, np.uint8), np.arange(_TABLED, dtype=np.int32)
    for code in range(0x80, _TABLED):
        c = chr(code)
        if unicodedata.category(c)[0] in "LNM":
            kind[code] = 1
            small = c.lower()
            if len(small) == 1 and small != c and (code >= 0x800) == (ord(small) >= 0x800) and (code >= 0x10000) == (ord(small) >= 0x10000) and ord(small) >= 0x80:
                lower[code] = ord(small)
    for lo, hi in _SINGLE:
        kind[lo : hi + 1] = np.where(kind[lo : hi + 1] > 0, 2, 0)
    return kind, lower


def folded(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case, 0 for those of characters that no word holds; and where a new word begins in any case."""
    b = _FOLD[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if not lead.size:
        return b, lead
    kind, lower = _unicode()
    size = 2 + (buf[lead] >= 0xE0).astype(np.int64) + (buf[lead] >= 0xF0)
    whole = lead + size <= len(buf)
    lead, size = lead[whole], size[whole]
    code = buf[lead].astype(np.int32) & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | (buf[lead[more] + k] & 0x3F)
    # Beyond the table lie only the Han extensions.
    low = np.minimum(code, _TABLED - 1)
    what = np.where(code < _TABLED, kind[low], 2)
    for k in range(4):
        b[lead[(what == 0) & (size > k)] + k] = 0
    small = np.where(code < _TABLED, lower[low], code)
    other = (small != code) & (what > 0)
    at, n, small = lead[other], size[other], small[other]
    for k in range(4):
        some = n > k
        rest = small[some] >> 6 * (n[some] - 1 - k)
        b[at[some] + k] = np.where(k > 0, rest & 0x3F | 0x80, rest | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n[some]]).astype(np.uint8)
    alone = what == 2
    return b, np.union1d(lead[alone], lead[alone] + size[alone])


def fold(buf: np.ndarray) -> np.ndarray:
    """Bytes in lower case, 0 for those of characters that no word holds."""
    return folded(buf)[0]


def runs(inside: np.ndarray, off: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which neither row boundaries nor breaks (places of bytes) join."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[first] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[last] = False
    if breaks is not None and breaks.size:
        before[breaks[breaks < len(inside)]] = False
        after[breaks[breaks > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded words of the rows: 64-bit hash, byte start, byte end, and how many words lie before each row's end.

    A word is a run of letters, marks and numbers of any script; a Han or kana character is a word by itself.
    """
    b, breaks = folded(buf)
    start, end = runs(b != 0, off, breaks)
    return span(prefix(b), start, end), start, end, np.searchsorted(start, off)


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens between white space: byte start, byte end, and how many lie before each row's end."""
    start, end = runs(~_SPACE[buf], off)
    return start, end, np.searchsorted(start, off)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def binary_array(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column from one buffer; counts are bytes."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
