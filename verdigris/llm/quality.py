"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the counts of all vote
patterns estimates each labeller's accuracy (how it votes on good and on bad documents) without any true label, and
the posterior of a pattern is the soft label of its documents. A linear scorer over hashed byte trigrams is trained on
the posterior labels of a bounded sample and then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import identified, rows_with_id
from .textnum import U64, binary_array, fold, prefix, ranges, runs, span, text_slices, tokens

SLOTS = 1 << 12
#: Bound of the sample that the scorer is trained on: the documents with the smallest hashes of doc_id.
TRAIN_DOCUMENTS = 3000
THRESHOLD = 0.5
LABELLERS = ("symbols", "capitals", "repetition", "sentences", "word_length", "bars", "vocabulary", "letters", "plain", "stutter")
#: Words of the stretches that a text's vocabulary is looked at in, so that its length has no say.
STRETCH = 200
#: Bytes of the table of rows and slots that examples are made in.
_TABLE = 1 << 24

_CODE = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 other mark, 6 bar, 7 space
_CODE[ord("a") : ord("z") + 1] = 1
_CODE[128:] = 1
_CODE[ord("A") : ord("Z") + 1] = 2
_CODE[ord("0") : ord("9") + 1] = 3
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~":
    _CODE[_c] = 5
for _c in b".,":
    _CODE[_c] = 4
_CODE[ord("|")] = 6
_CODE[[9, 10, 11, 12, 13, 32]] = 7


def measures(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Per-document ratios that the labellers look at."""
    n = len(off) - 1
    length = np.maximum(np.diff(off), 1)
    row = np.repeat(np.arange(n), np.diff(off))
    code = np.bincount(row * 8 + _CODE[buf], minlength=8 * n).reshape(n, 8)
    start, end, at = tokens(buf, off)
    folded = fold(buf)
    h = span(prefix(folded), start, end)
    words = np.maximum(np.diff(at), 1)
    owner = np.repeat(np.arange(n), np.diff(at))
    lines, line_end = runs(buf != 10, off)
    line_row = np.searchsorted(off, lines, "right") - 1

    def repeated(key: np.ndarray, who: np.ndarray, weight: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, who))
        k, w = key[order], who[order]
        again = np.append(False, (k[1:] == k[:-1]) & (w[1:] == w[:-1])) if len(k) else np.zeros(0, bool)
        return np.bincount(w, weight[order] * again, n) / np.maximum(np.bincount(who, weight, n), 1)

    pre = prefix(h)
    grams = np.maximum(np.diff(at) - 4, 0)
    gram_row = np.repeat(np.arange(n), grams)
    gram_at = np.repeat(at[:-1], grams) + ranges(grams)
    letters = np.maximum(code[:, 1] + code[:, 2], 1)
    stretches = -(-np.diff(at) // STRETCH)
    stretch = np.repeat(np.cumsum(stretches) - stretches, np.diff(at)) + ranges(np.diff(at)) // STRETCH
    order = np.lexsort((h, stretch))
    again = np.append(False, (h[order][1:] == h[order][:-1]) & (stretch[order][1:] == stretch[order][:-1])) if len(h) else np.zeros(0, bool)
    mark = np.append(0, np.cumsum((_CODE[buf] == 5) | (_CODE[buf] == 6)))
    same = np.append(False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) if len(h) else np.zeros(0, bool)
    return {
        "symbols": code[:, 5] / length,
        "upper": code[:, 2] / letters,
        "repeats": np.maximum(repeated(span(pre, gram_at, gram_at + 5), gram_row, np.ones(len(gram_at))), repeated(span(prefix(buf), lines, line_end), line_row, (line_end - lines).astype(float))),
        "ended": code[:, 4] / words,
        "mean_word": np.bincount(owner, end - start, n) / words,
        "bars": code[:, 6] / words,
        "distinct": 1 - np.bincount(owner[order], again, n) / words,
        "letters": (code[:, 1] + code[:, 2]) / np.maximum(length - code[:, 7], 1),
        "plain": 1 - np.bincount(owner, mark[end] > mark[start], n) / words,
        "stutter": np.bincount(owner, same, n) / words,
        "words": np.diff(at),
    }


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """n x labellers: 1 good, 0 bad, 2 no opinion."""
    few = m["words"] < 20

    def rule(bad: np.ndarray, good: np.ndarray, needs_words: bool = False) -> np.ndarray:
        v = np.where(bad, 0, np.where(good, 1, 2))
        return np.where(few, 2, v) if needs_words else v

    return np.stack(
        [
            rule(m["symbols"] > 0.08, m["symbols"] < 0.02),
            rule(m["upper"] > 0.5, m["upper"] < 0.15),
            rule(m["repeats"] > 0.3, m["repeats"] < 0.05, True),
            rule((m["ended"] < 0.01) | (m["ended"] > 0.7), (m["ended"] > 0.03) & (m["ended"] < 0.4), True),
            rule((m["mean_word"] > 14) | (m["mean_word"] < 2.2), (m["mean_word"] > 3) & (m["mean_word"] < 9)),
            rule(m["bars"] > 0.2, (m["bars"] < 0.01) & ~few),
            rule(m["distinct"] < 0.12, m["distinct"] > 0.3, True),
            rule(m["letters"] < 0.89, m["letters"] > 0.92),
            rule(m["plain"] < 0.6, m["plain"] > 0.85),
            rule(m["stutter"] > 0.2, m["stutter"] < 0.03),
        ],
        axis=1,
    )


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, table[class, labeller, vote] and the posterior of good for each pattern; no opinion tells nothing.

    Starts from the belief that labellers are right more often than wrong; that also fixes which class is good. One
    document of each kind is added to all counts, so that no estimate is 0.
    """
    k = patterns.shape[1]
    # A document counts as bad at first when any labeller says so: the labellers look at different faults.
    bad = (patterns == 0).any(axis=1)
    post = np.where(bad, 0.02, np.where((patterns == 1).any(axis=1), 0.99, 0.5))
    one_hot = np.stack([patterns == v for v in (0, 1)], axis=2).astype(float)
    prior, table = 0.5, np.full((2, k, 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        table = np.einsum("cp,pkv->ckv", weight, one_hot) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        logs = np.einsum("pkv,ckv->cp", one_hot, np.log(table)) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    if (table[0, :, 0].sum() < table[1, :, 0].sum()):
        prior, table, post = 1 - prior, table[::-1], 1 - post
    return prior, table, post


def _packed(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _unpacked(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def features(buf: np.ndarray, off: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all rows, end to end, and each row's count."""
    n = np.maximum(np.diff(off) - 2, 0)
    at = np.repeat(off[:-1], n) + ranges(n)
    b = buf.astype(np.uint32)
    slot = ((b[at] * np.uint32(65599) + b[at + 1]) * np.uint32(65599) + b[at + 2]) * np.uint32(2654435761) >> np.uint32(32 - (slots - 1).bit_length())
    return slot.astype(np.int64), n


def _row_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    c = np.append(0.0, np.cumsum(values))
    end = np.cumsum(n)
    return c[end] - c[end - n]


def _vote_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, buf, off in text_slices(batch.column("text")):
            code, count = np.unique(_packed(votes(measures(buf, off))), return_counts=True)
            yield pa.record_batch([pa.array(code), pa.array(count)], names=["code", "n"])


def _few_rows(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """text_slices() of at most so many rows each."""
    for lo, hi, buf, off in text_slices(column):
        for k in range(0, hi - lo, most):
            end = min(k + most, hi - lo)
            yield lo + k, lo + end, buf[off[k] : off[end]], off[k : end + 1] - off[k]


def decisions(buf: np.ndarray, off: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The scorer's value of each row: square roots of the shares of its distinct slots, weighted and summed."""
    slots = len(weights) - 1
    slot, n = features(buf, off, slots)
    # Square-rooted counts aren't additive, so each row's distinct slots are counted first: by a sort, whose room
    # depends on the bytes alone.
    key = np.repeat(np.arange(len(n), dtype=np.int64), n) * slots + slot
    if len(n) * slots < 1 << 32:
        key = key.astype(np.uint32)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    row, slot = key[first].astype(np.int64) // slots, key[first].astype(np.int64) % slots
    return np.bincount(row, np.sqrt(count / np.maximum(n, 1)[row]) * weights[slot].astype(float), len(n)) + float(weights[-1])


def _examples(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in _few_rows(batch.column("text"), _TABLE // (8 * slots)):
                slot, n = features(buf, off, slots)
                x = np.bincount(np.repeat(np.arange(hi - lo), n) * slots + slot, minlength=(hi - lo) * slots).reshape(hi - lo, slots) / np.maximum(n, 1)[:, None]
                x = np.sqrt(x).astype(np.float16)
                yield pa.record_batch([pa.array(_packed(votes(measures(buf, off)))), binary_array(x.view(np.uint8).reshape(-1), np.full(hi - lo, 2 * slots))], names=["code", "x"])

    return run


def train_linear(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the intercept."""
    n, d = x.shape
    w, m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        e = (p - y).astype(np.float32)
        g = np.append(x.T @ e / n + decay * w[:-1], e.mean()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def fit(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, slots: int = SLOTS) -> tuple[np.ndarray, dict]:
    """Weights of the scorer, and what the labellers were found to be worth. Vote patterns come from all documents."""
    seen = docs.mapInArrow(_vote_codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    if not len(seen):
        return np.zeros(slots + 1, np.float32), {"prior": 0.5, "accuracy": {}}
    prior, table, post = estimate(_unpacked(seen["code"].to_numpy()), seen["n"].to_numpy(float))
    label = dict(zip(seen["code"].tolist(), post.tolist()))
    # A hash bound that twice the wanted number passes keeps texts from travelling to the sort that picks the sample.
    share = min(1.0, (2.0 * train_documents + 100) / float(seen["n"].sum()))
    order = F.xxhash64("doc_id")
    sample = docs.where(order <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).orderBy(order, "doc_id").limit(train_documents)
    rows = sample.mapInArrow(_examples(slots), "code long, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, slots), np.float32)
    y = np.array([label[r["code"]] for r in rows], np.float32)
    accuracy = {name: (float(table[1, k, 1]), float(table[0, k, 0])) for k, name in enumerate(LABELLERS)}
    return train_linear(x, y) if len(y) else np.zeros(slots + 1, np.float32), {"prior": prior, "accuracy": accuracy}


def _scorer(weights: np.ndarray, keep_columns: bool, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column("text")):
                p = 1 / (1 + np.exp(-np.clip(decisions(buf, off, weights), -30, 30)))
                p = np.where(np.diff(off) < 3, 0.0, p)
                if keep_columns:
                    yield batch.slice(lo, hi - lo).filter(pa.array(p >= threshold))
                else:
                    yield pa.record_batch([batch.column("doc_id")[lo:hi], pa.array(p), pa.array(p >= threshold)], names=["doc_id", "quality", "keep"])

    return run


def quality_scores(docs: DataFrame, threshold: float = THRESHOLD, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """(doc_id, quality, keep) for every document: the probability of being good, and whether it is kept.

    Null and empty texts, and those of under three bytes, score 0. Rows with a null doc_id are left out; repeated rows
    are scored each. An empty table gives no rows.
    """
    docs = identified(docs)
    weights, _ = fit(docs, train_documents)
    return docs.mapInArrow(_scorer(weights, False, threshold), "doc_id long, quality double, keep boolean")


def good_documents(docs: DataFrame, threshold: float = THRESHOLD, train_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """documents that the classifier keeps, with documents' columns and no others.

    Null and empty texts, and those of under three bytes, score 0 and go; rows with a null doc_id are judged like any
    other; repeated rows are judged each. An empty table stays empty.
    """
    weights, _ = fit(identified(docs), train_documents)
    docs = rows_with_id(docs)
    return docs.mapInArrow(_scorer(weights, True, threshold), docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
