"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings sums, over all subsequences of three characters, the product of their weights in both; an
occurrence weighs DECAY to the power of the span that it covers, spans of up to SPAN characters count. Characters put
between the letters of an insult only widen spans, so "id*iot" and "i d i o t" stay near "idiot". Punctuation and
spaces take part as gaps alone, digits read as the letters that they stand for.

A document is a bag of strings: its tokens, runs of single letters as one string, and up to WINDOW neighbouring ones
joined, so that "id iot" is scored as one. The document is as toxic as its worst string. The machine learns from single
strings; joined ones take part in the choice of the threshold. Labelled documents train the machine: strings of clean ones are
negative, FIRST_NEGATIVES random ones and in each turn the HARD_NEGATIVES that look worst, and of a toxic document those
that the current machine holds to be the witnesses are positive. Landmarks are chosen by pivoted Cholesky; since kernel values with fixed landmarks are linear in a string's
subsequence weights, the whole machine folds into one weight for each of 64**3 subsequences, and scoring a string needs
lookups only: that is exact, whatever the number of landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import identified, rows_with_id, table
from .textnum import U64, fold, prefix, ranges, runs, span, text_buffer, text_slices, tokens

SPAN, DECAY = 8, 0.45
LANDMARKS = 256
#: So many neighbouring strings at most are also scored as one.
WINDOW = 4
#: Bytes of text that are scored at once, few enough for the arrays to stay in a core's cache; no value depends on it.
SCORED_BYTES = 1 << 18
#: Bounds of the labelled sample, of each class: the documents with the smallest hashes of doc_id.
TRAIN_TOXIC, TRAIN_CLEAN = 1000, 3000
ROUNDS = 5
#: Bounds of what a round trains on: random clean strings at first, the hardest clean ones that each round adds, the
#: positive strings of most documents; and positive and clean strings that landmarks are chosen from.
FIRST_NEGATIVES, HARD_NEGATIVES, POSITIVES = 2500, 1200, 2500
POSITIVE_PIVOTS, NEGATIVE_PIVOTS = 600, 1000
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_PAD = SPAN - 1

_CODE = np.zeros(256, np.uint8)
_CODE[ord("a") : ord("z") + 1] = np.arange(1, 27)
for _digit, _letter in zip(b"013457", b"oieast"):
    _CODE[_digit] = _letter - 96


def characters(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 64 of the characters (0 for what is no letter), and the place of each byte's character."""
    b = fold(buf)
    code = _CODE[b]
    lead = np.flatnonzero(buf >= 0xC0)
    h = b[lead].astype(np.int64) * 7
    for k in (1, 2):
        at = np.minimum(lead + k, max(len(b) - 1, 0))
        h = np.where((buf[at] & 0xC0) == 0x80, h * 31 + b[at], h)
    code[lead] = np.where(b[lead] > 0, 27 + (h * 2654435761 >> 7) % 37, 0)
    first = (buf & 0xC0) != 0x80
    return code[first], np.append(0, np.cumsum(first))


def strings(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, start and end of each string that holds a letter, and how many lie before each row's end."""
    code, char_at = characters(buf, off)
    start, end, at = tokens(buf, off)
    start, end = char_at[start], char_at[end]
    letters = np.append(0, np.cumsum(code > 0))
    single = (letters[end] - letters[start] == 1) & (end - start <= 3)
    lo, hi = runs(single, at)
    long = hi - lo >= 3
    lo, hi = lo[long], hi[long]
    keep = np.ones(len(start), bool)
    for k, h in zip(lo, hi):
        end[k] = end[h - 1]
        keep[k + 1 : h] = False
    before = np.append(0, np.cumsum(keep))
    start, end, at = start[keep], end[keep], before[at]
    some = np.flatnonzero(code)
    first, last = np.searchsorted(some, start), np.searchsorted(some, end)
    keep = last > first
    before = np.append(0, np.cumsum(keep))
    return code, some[first[keep]], some[last[keep] - 1] + 1, before[at]


def distinct(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings, laid out with gaps that no span crosses: codes, starts, hashes; and each string's number."""
    h = span(prefix(code), start, end) if len(start) else np.zeros(0, U64)
    h, first, which = np.unique(h, return_index=True, return_inverse=True)
    n = end[first] - start[first]
    begin = np.cumsum(n + _PAD) - n - _PAD
    out = np.zeros(int((n + _PAD).sum()) + _PAD, np.int64)
    k = ranges(n)
    out[np.repeat(begin, n) + k] = code[np.repeat(start[first], n) + k]
    return out, begin, h, which


def subsequences(out: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, weight) summed over the occurrences, sorted by string."""
    where = np.flatnonzero(out)
    owner = np.searchsorted(begin, where, "right") - 1
    who, what, weight = [], [], []
    for a, b in _PAIRS:
        c1, c2 = out[where + a], out[where + b]
        ok = np.flatnonzero((c1 > 0) & (c2 > 0))
        who.append(owner[ok])
        what.append(out[where[ok]] << 12 | c1[ok] << 6 | c2[ok])
        weight.append(np.full(len(ok), DECAY ** (b + 1)))
    key = np.concatenate(who) << 18 | np.concatenate(what)
    key, inverse = np.unique(key, return_inverse=True)
    return key >> 18, key & (1 << 18) - 1, np.bincount(inverse, np.concatenate(weight), len(key))


def norms(out: np.ndarray, begin: np.ndarray) -> np.ndarray:
    who, _, weight = subsequences(out, begin)
    return np.sqrt(np.bincount(who, weight * weight, len(begin)))


def _selected(out: np.ndarray, begin: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The layout of some of the strings."""
    n = n[which]
    at = np.cumsum(n + _PAD) - n - _PAD
    part = np.zeros(int((n + _PAD).sum()) + _PAD, np.int64)
    part[np.repeat(at, n) + ranges(n)] = out[np.repeat(begin[which], n) + ranges(n)]
    return part, at


def scores(out: np.ndarray, begin: np.ndarray, machine: np.ndarray) -> np.ndarray:
    """The machine's value of each distinct string; its own norm is found only where the sign is positive."""
    if not len(begin):
        return np.zeros(0)
    where = np.flatnonzero(out[: len(out) - _PAD])
    at = [out[where] << 12] + [out[where + k] for k in range(1, SPAN)]
    total = np.zeros(len(where), np.float32)
    for b in range(2, SPAN):
        part = np.zeros(len(where), np.float32)
        for a in range(1, b):
            part += machine[at[0] | at[a] << 6 | at[b]]
        total += part * np.float32(DECAY ** (b + 1))
    value = np.bincount(np.searchsorted(begin, where, "right") - 1, total, len(begin))
    n = np.diff(np.append(begin, len(out) - _PAD)) - _PAD
    raised = np.flatnonzero(value > 1e-9)
    for k in range(0, len(raised), 4096):
        up = raised[k : k + 4096]
        value[up] /= np.maximum(norms(*_selected(out, begin, n, up)), 1e-9)
    return value


def _joins(code: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, machine: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Row, start, end and raw value of runs of more than least, up to WINDOW, neighbouring strings of a row, where that
    is positive, and what their value can be at most."""
    n = len(start)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    final = at[1:][row] - 1
    own = np.repeat(np.arange(n), end - start)
    where = np.repeat(start, end - start) + ranges(end - start)
    some = code[where] > 0
    own, where = own[some], where[some]
    padded = np.append(code, np.zeros(SPAN, code.dtype)).astype(np.int32)
    first = padded[where] << 12
    x = [padded[where + k] for k in range(1, SPAN)]
    start_with = [first | v << 6 for v in x]
    # Row b: what the subsequences from a place weigh that span at most b characters.
    weight, square = np.zeros((SPAN + 1, len(where)), np.float32), np.zeros((SPAN + 1, len(where)), np.float32)
    between, one, key = np.zeros(len(where), np.float32), np.empty(len(where), np.float32), np.empty(len(where), np.int32)
    for b in range(2, SPAN):
        part = weight[b + 1]
        for a in range(1, b):
            np.bitwise_or(start_with[a - 1], x[b - 1], out=key)
            np.take(machine, key, out=one, mode="clip")
            part += one
        part *= np.float32(DECAY ** (b + 1))
        part += weight[b]
        between += x[b - 2] > 0
        np.multiply(between, x[b - 1] > 0, out=one)
        one *= np.float32(DECAY ** (2 * b + 2))
        np.add(square[b], one, out=square[b + 1])
    del start_with, x, first
    place = np.arange(len(where))
    sums, squares = [], []
    for m in range(WINDOW):
        room = np.clip(end[np.minimum(np.arange(n) + m, final)][own] - where, 0, SPAN)
        sums.append(np.bincount(own, weight[room, place], n))
        squares.append(np.bincount(own, square[room, place], n))
    # Each string's subsequences that end within the string itself, the next one, and so on.
    found = []
    for m in range(least, WINDOW):
        k = np.flatnonzero(np.arange(n) + m <= final)
        raw = sum(sums[m - j][k + j] for j in range(m + 1))
        # Equal subsequences add up before they are squared, so the norm is no less than this.
        norm = np.sqrt(sum(squares[m - j][k + j] for j in range(m + 1)))
        up = raw > 1e-9
        found.append((row[k[up]], start[k[up]], end[k[up] + m], raw[up], 1.001 * raw[up] / np.maximum(norm[up], 1e-9)))
    return tuple(np.concatenate(v) for v in zip(*found))


def _values(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, raw: np.ndarray) -> np.ndarray:
    out, begin, _, same = distinct(code, lo, hi)
    size, norm = np.diff(np.append(begin, len(out) - _PAD)) - _PAD, np.zeros(len(begin))
    for first in range(0, len(begin), 4096):
        some = np.arange(first, min(first + 4096, len(begin)))
        norm[some] = norms(*_selected(out, begin, size, some))
    return raw / np.maximum(norm[same], 1e-9)


def _raised(best: np.ndarray, code: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, raw: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Each row's highest value of its runs, or what it had if that is higher.

    Norms take most of the time, so they are found only of runs that a bound can't rule out: each row's likeliest run
    raises the bar for its others, twice, then all that are left are looked at.
    """
    best = best.copy()
    left = np.flatnonzero(most > best[of])
    for _ in range(2):
        bound = np.zeros(len(best))
        np.maximum.at(bound, of[left], most[left])
        top = left[most[left] == bound[of[left]]]
        np.maximum.at(best, of[top], _values(code, lo[top], hi[top], raw[top]))
        left = left[(most[left] > best[of[left]]) & (most[left] < bound[of[left]])]
    np.maximum.at(best, of[left], _values(code, lo[left], hi[left], raw[left]))
    return best


def joined(code: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, machine: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of runs of 2 to WINDOW neighbouring strings of a row, where the value is positive.

    With a floor for each row, only each row's highest value, at least its floor.
    """
    of, lo, hi, raw, most = _joins(code, start, end, at, machine, 1)
    if floor is None:
        return of, _values(code, lo, hi, raw)
    return np.arange(len(floor)), _raised(floor, code, of, lo, hi, raw, most)


def worst(buf: np.ndarray, off: np.ndarray, machine: np.ndarray) -> np.ndarray:
    """Each row's highest value of a string or of joined ones; 0 for rows without strings."""
    code, start, end, at = strings(buf, off)
    none = np.zeros(len(off) - 1)
    return _raised(none, code, *_joins(code, start, end, at, machine, 0)) if len(start) else none


def _landmarks(rows: np.ndarray, m: int) -> np.ndarray:
    """Pivoted Cholesky: at each step the row that the chosen ones explain least."""
    left, basis, chosen = np.einsum("ij,ij->i", rows, rows), [], []
    for _ in range(min(m, len(rows))):
        j = int(np.argmax(left))
        if left[j] < 1e-6:
            break
        col = rows @ rows[j]
        for b in basis:
            col -= b * b[j]
        col /= np.sqrt(left[j])
        basis.append(col)
        chosen.append(j)
        left = np.maximum(left - col * col, 0)
    return np.array(chosen)


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the intercept."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    active = None
    for _ in range(rounds):
        now = y * (x @ w) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
    return w


class _Bags:
    """Strings of labelled documents: distinct ones, and which document holds which."""

    def __init__(self, texts: list[str | None]):
        buf, off = text_buffer(pa.array(texts, pa.string()))
        code, start, end, at = strings(buf, off)
        self.out, self.begin, _, which = distinct(code, start, end)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        pair = np.unique(doc * len(self.begin) + which) if len(which) else np.zeros(0, np.int64)
        self.doc, self.string = (pair // max(len(self.begin), 1), pair % max(len(self.begin), 1))

    def best(self, value: np.ndarray, docs: int) -> np.ndarray:
        out = np.zeros(docs)
        np.maximum.at(out, self.doc, value[self.string])
        return out


def _first_guess(bags: _Bags, toxic: np.ndarray) -> np.ndarray:
    """How far each string's 3- to 5-grams are more frequent in toxic documents than chance has it."""
    guess = np.full(len(bags.begin), -np.inf)
    pre = prefix(bags.out)
    doc_of, string_of = bags.doc.astype(np.int32), bags.string
    length = np.diff(np.append(bags.begin, len(bags.out) - _PAD)) - _PAD
    share = toxic.mean()
    for size in (3, 4, 5):
        n = np.maximum(length - size + 1, 0)
        owner = np.repeat(np.arange(len(length)), n)
        at = np.repeat(bags.begin, n) + ranges(n)
        _, gram = np.unique(span(pre, at, at + size), return_inverse=True)
        begin = np.cumsum(n) - n
        grams = int(gram.max(initial=0)) + 1
        seen, bad = np.zeros(grams), np.zeros(grams)
        # Documents in runs: only one run's pairs of document and gram are held at a time.
        for lo in range(0, len(doc_of), 200_000):
            lo, hi = (0 if lo == 0 else int(np.searchsorted(doc_of, doc_of[lo]))), (len(doc_of) if lo + 200_000 >= len(doc_of) else int(np.searchsorted(doc_of, doc_of[lo + 200_000])))
            many = n[string_of[lo:hi]]
            pair = np.unique(np.repeat(doc_of[lo:hi].astype(np.int64), many) * grams + gram[np.repeat(begin[string_of[lo:hi]], many) + ranges(many)])
            doc, g = pair // grams, pair % grams
            seen += np.bincount(g, minlength=grams)
            bad += np.bincount(g, toxic[doc], grams)
        z = (bad - seen * share) / np.sqrt(seen * share * (1 - share) + 1)
        np.maximum.at(guess, owner, z[gram])
    return guess


def _cutoff(best: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold that errs least on the sample; taking a clean document for toxic counts three times."""
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(np.where(toxic[order] == 1, -1.0, 3.0))
    edge = np.append(best[order][1:] < best[order][:-1], True)
    cutoff = int(np.argmin(np.where(edge, wrong, np.inf)))
    below = best[order][cutoff + 1] if cutoff + 1 < len(best) else 0.0
    return float((best[order][cutoff] + below) / 2)


def train(texts: list[str | None], labels: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(machine, threshold) from labelled texts; without both classes nothing is toxic."""
    machine = np.zeros(1 << 18, np.float32)
    toxic = np.asarray(labels, float)
    if not len(toxic) or toxic.min() == toxic.max():
        return machine, np.inf
    bags = _Bags(texts)
    clean = np.zeros(len(bags.begin), bool)
    clean[bags.string[toxic[bags.doc] == 0]] = True
    held = np.bincount(bags.string[toxic[bags.doc] == 1], minlength=len(clean)).astype(float)
    value = _first_guess(bags, toxic)
    value[clean & (value < 6)] = -np.inf  # too common among the clean to start from
    sizes = np.diff(np.append(bags.begin, len(bags.out) - _PAD)) - _PAD
    rng = np.random.default_rng(seed)
    everyday = np.flatnonzero(clean)
    negatives = rng.permutation(everyday)[:FIRST_NEGATIVES]
    bar = 6.0
    threshold = np.inf
    first = (value >= bar) & (held > 0) & ~clean
    for _ in range(rounds):
        # Witnesses: strings beyond the bar and, in each toxic document, the strongest one.
        best = bags.best(np.where(np.isfinite(value), value, -1e9) - bar, len(toxic)) + bar
        top = (value[bags.string] >= np.where(toxic[bags.doc] == 1, np.maximum(best[bags.doc], bar), np.inf)) & np.isfinite(value[bags.string])
        positive = np.zeros(len(clean), bool)
        positive[bags.string[top]] = True
        positive &= ~clean
        positive |= first
        pos = np.flatnonzero(positive)
        pos = pos[np.argsort(-held[pos], kind="stable")][:POSITIVES]
        hard = np.flatnonzero(clean & ~positive & np.isfinite(value))
        hard = hard[np.argsort(-value[hard], kind="stable")][:HARD_NEGATIVES]
        negatives = np.concatenate([np.setdiff1d(negatives, hard), hard])
        neg = negatives[~positive[negatives]][::-1]
        use = np.concatenate([pos, neg])
        if not len(pos) or not len(neg):
            break
        who, what, weight = subsequences(*_selected(bags.out, bags.begin, sizes, use))
        norm = np.sqrt(np.bincount(who, weight * weight, len(use)))
        usable = norm > 0
        weight = weight / np.maximum(norm[who], 1e-12)
        # Pivots come from the positives and as many negatives, the hardest first.
        pool = np.concatenate([np.flatnonzero(usable[: len(pos)])[:POSITIVE_PIVOTS], len(pos) + np.flatnonzero(usable[len(pos) :])[:NEGATIVE_PIVOTS]])
        mark = np.full(len(use), -1)
        mark[pool] = np.arange(len(pool))
        seen, column = np.unique(what[mark[who] >= 0], return_inverse=True)
        dense = np.zeros((len(pool), len(seen)), np.float32)
        dense[mark[who[mark[who] >= 0]], column] = weight[mark[who] >= 0]
        chosen = _landmarks(dense, landmarks)
        marks = dense[chosen]
        at = np.searchsorted(seen, what)
        known = (at < len(seen)) & (seen[np.minimum(at, len(seen) - 1)] == what)
        kernel = np.zeros((len(use), len(chosen)))
        in_row, column, by = who[known], at[known], weight[known]
        for k in range(len(chosen)):
            kernel[:, k] = np.bincount(in_row, marks[k][column] * by, len(use))
        e, u = np.linalg.eigh((marks @ marks.T).astype(float) + 1e-3 * np.eye(len(chosen)))
        root = u / np.sqrt(np.maximum(e, 1e-6)) @ u.T
        z = kernel @ root
        y = np.where(np.arange(len(use)) < len(pos), 1.0, -1.0)
        # A witness of many documents weighs more than a rare one.
        cost = np.full(len(use), 10.0)
        cost[: len(pos)] *= len(neg) / 4 * np.sqrt(held[pos] + 1) / np.sqrt(held[pos] + 1).sum()
        w = _svm(z[usable], y[usable], cost[usable])
        machine = np.zeros(1 << 18, np.float32)
        machine[seen] = marks.T @ (root @ w[:-1])
        value = scores(bags.out, bags.begin, machine)
        value[value <= 0] = -np.inf
        best = bags.best(np.where(np.isfinite(value), value, 0), len(toxic))
        threshold = _cutoff(best, toxic)
        bar = max(threshold, 1e-6)
    if np.isfinite(threshold):
        whole = [worst(part, off, machine) for _, _, part, off in text_slices(pa.array(texts, pa.string()), SCORED_BYTES)]
        threshold = _cutoff(np.concatenate(whole), toxic)
    return machine, threshold


def fit(docs: DataFrame, labels: DataFrame, train_toxic: int = TRAIN_TOXIC, train_clean: int = TRAIN_CLEAN) -> tuple[np.ndarray, float]:
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # Labels of documents that the table lacks use up nothing of the sample.
    labels = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = labels.where("toxic = 1").orderBy(*order).limit(train_toxic).union(labels.where("toxic = 0").orderBy(*order).limit(train_clean))
    # The sample's size is bounded by the two parameters, so it is small enough to broadcast at any scale, and one task
    # trains on it.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    found = sample.repartition(1).mapInArrow(_trained, "machine binary, threshold double").first()
    if found is None:  # no labelled document
        return np.zeros(1 << 18, np.float32), np.inf
    return np.frombuffer(bytes(found["machine"]), np.float32), found["threshold"]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")))), key=lambda r: (r[0], r[1] or "", r[2]))
    machine, threshold = train([r[1] for r in rows], np.array([r[2] for r in rows]))
    yield pa.record_batch([pa.array([machine.tobytes()], pa.binary()), pa.array([threshold], pa.float64())], names=["machine", "threshold"])


def _scored(machine: np.ndarray, threshold: float, columns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column("text"), SCORED_BYTES):
                value = worst(buf, off, machine)
                if columns:
                    yield batch.slice(lo, hi - lo).filter(pa.array(~(value > threshold)))
                else:
                    yield pa.record_batch([batch.column("doc_id")[lo:hi], pa.array(value), pa.array(value > threshold)], names=["doc_id", "toxicity", "toxic"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, toxicity, toxic) of every document.

    Null and empty texts score 0 and are not toxic; rows with a null doc_id are left out; repeated rows are scored
    each. Labels that are null or neither 0 nor 1 are ignored; of several labels of a document the highest counts.
    Without labels of both kinds nothing is toxic. An empty table gives no rows.
    """
    docs = identified(docs)
    machine, threshold = fit(docs, labels, **bounds)
    return docs.mapInArrow(_scored(machine, threshold, False), "doc_id long, toxicity double, toxic boolean")


def civil_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """documents that are not toxic, with documents' columns and no others.

    Null and empty texts stay, as do rows with a null doc_id (unless their text is toxic); repeated rows are judged
    each; without labels of both kinds all stay. An empty table gives no rows.
    """
    machine, threshold = fit(identified(docs), labels, **bounds)
    docs = rows_with_id(docs)
    return docs.mapInArrow(_scored(machine, threshold, True), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with their scores: every document is scored, those below the threshold are not reported."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("toxic")
