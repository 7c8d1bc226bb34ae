import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import LONG, ODD

from verdigris.llm import minhash, suffix_array
from verdigris.llm.components import components
from verdigris.llm.textnum import fold, text_buffer, words


def bags(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out[i] = Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)
    return out


def near_groups(texts, threshold):
    b, root = bags(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(b)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            common = sum((b[x] & b[y]).values())
            total = sum(b[x].values()) + sum(b[y].values()) - common
            if total and common / total >= threshold:
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {(i, find(i)) for i in ids if find(i) != i}


def repeats(texts, size):
    """(doc, first doc, word) of every word that a window covers which two documents hold."""
    hashes = {}
    for i, t in texts.items():
        hashes[i] = words(*text_buffer(pa.array([t], pa.string())))[0]
    where = defaultdict(set)
    for i, h in hashes.items():
        for s in range(len(h) - size + 1):
            where[h[s : s + size].tobytes()].add(i)
    out = set()
    for i, h in hashes.items():
        for s in range(len(h) - size + 1):
            docs = where[h[s : s + size].tobytes()]
            if len(docs) > 1:
                out |= {(i, min(docs), w) for w in range(s, s + size)}
    return out


def covered(rows):
    return {(r["doc_id"], r["first_doc_id"], w) for r in rows for w in range(r["start_word"], r["end_word"])}


def test_near_duplicates_match_brute_force(documents, texts):
    found = {tuple(r) for r in minhash.near_duplicates(documents).collect()}
    assert found == near_groups(texts, minhash.THRESHOLD)


def test_signatures_estimate_weighted_jaccard():
    a = "x y z p q r s t u v w " * 4
    b = a + "aa bb cc dd ee ff gg hh ii jj kk ll"
    row, key, n = minhash.shingles(*text_buffer(pa.array([a, b])))
    sig = minhash.bag_signatures(2, row, key, n, 4096)
    bag = [dict(zip(key[row == k], n[row == k])) for k in (0, 1)]
    keys = set(bag[0]) | set(bag[1])
    exact = sum(min(bag[0].get(k, 0), bag[1].get(k, 0)) for k in keys) / sum(max(bag[0].get(k, 0), bag[1].get(k, 0)) for k in keys)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_near_duplicates_of_odd_rows(make):
    docs = make([*ODD, (9, "ok text here"), (10, LONG + "end"), (11, LONG)])
    assert {tuple(r) for r in minhash.near_duplicates(docs).collect()} == {(9, 8), (10, 5), (11, 5)}
    left = [r["doc_id"] for r in minhash.keep_one(docs).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, 8, None]))
    assert minhash.near_duplicates(make([])).count() == 0


def test_a_chain_of_copies_is_one_group(make):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[k * 12 :] + [f"n{j}" for j in range(k * 12)])) for k in range(6)]
    found = {tuple(r) for r in minhash.near_duplicates(make(rows)).collect()}
    assert found == near_groups(dict(rows), minhash.THRESHOLD)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (7, 7), (1, None), (10, 9), (2, 10)], "a long, b long")
    assert {tuple(r) for r in components(edges, "a", "b").collect()} == {(5, 3), (4, 3), (9, 2), (8, 2), (10, 2)}


def test_two_stage_sort_matches_sorted_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = np.append(rng.integers(0, 4, rng.integers(0, 60)), 0)
        keys = []
        for i in suffix_array.two_stage(text):
            rest = text[i:].tolist()
            keys.append(rest[: rest.index(0)])
        assert len(keys) == len(text) and keys == sorted(keys)


def test_repeated_passages_match_brute_force(documents, texts):
    assert covered(suffix_array.repeated_passages(documents).collect()) == repeats(texts, suffix_array.MIN_WORDS)


@pytest.mark.parametrize("size, gram", [(8, 3), (12, 12)])
def test_short_windows_match_brute_force(make, size, gram):
    rng = np.random.default_rng(size)
    texts = {i: " ".join(map(str, rng.integers(0, 3, rng.integers(0, 60)))) for i in range(40)}
    found = suffix_array.repeated_passages(make(list(texts.items())), size, gram).collect()
    assert covered(found) == repeats(texts, size)


def test_repeats_of_odd_rows(make):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = make([*ODD, (20, "a b " + passage + " c"), (21, passage), (22, passage + "\n" + passage), (22, passage + "\n" + passage), (None, passage)])
    found = covered(suffix_array.repeated_passages(docs).collect())
    assert {x[:2] for x in found} == {(20, 20), (21, 20), (22, 20)}
    assert suffix_array.repeated_passages(make([])).count() == 0
    left = {r["doc_id"]: r["text"] for r in suffix_array.without_repeats(docs).collect() if r["doc_id"] is not None}
    assert left[20] == "a b " + passage + " c" and left[1] is None and left[5] == LONG
    assert 21 not in left and 22 not in left
    assert suffix_array.without_repeats(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("symbols", [1, 400_000])
def test_a_hot_minimizer_is_done_by_hashes(make, symbols):
    rng = np.random.default_rng(11)
    texts = {i: " ".join(map(str, rng.integers(0, 3, rng.integers(0, 60)))) for i in range(40)}
    found = suffix_array.repeated_passages(make(list(texts.items())), 8, 3, symbols).collect()
    assert covered(found) == repeats(texts, 8)


def test_points_below_the_weight_are_those_of_their_halvings():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    for low, width in ((0, 1), (1, 1), (2, 2), (8, 8), (64, 64)):
        weight = rng.integers(low + 1, 2 * (low + width) + 2, len(h))
        bits = width.bit_length() - 1
        place = low + (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.full(len(h), low)
        assert np.array_equal(minhash.below(h, low, width, weight), place < weight)


def test_two_texts_under_one_doc_id_keep_to_themselves(make):
    shared, lone = (" ".join(f"{x}{k}" for k in range(100)) for x in "pu")
    a, b = shared, lone
    docs = make([(1, a), (5, a), (5, b), (7, b)])
    assert {tuple(r) for r in minhash.near_duplicates(docs).collect()} == {(5, 1), (7, 5)}
    assert sorted((r["doc_id"], r["text"]) for r in minhash.keep_one(docs).collect()) == [(1, a), (5, b)]
    docs = make([(20, " ".join(a.split()[:60])), (21, a), (21, b), (21, b)])
    left = sorted((r["doc_id"], r["text"]) for r in suffix_array.without_repeats(docs).collect())
    assert left == [(20, " ".join(a.split()[:60])), (21, " ".join(a.split()[60:])), (21, b), (21, b)]


def test_words_of_every_script():
    def brute(text):
        out, word = [], ""
        for c in text:
            part = unicodedata.category(c)[0] in "LNM"
            alone = part and bool(re.match("[ぁ-ゖァ-ヺㇰ-ㇿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]", c))
            if alone or not part:
                out += [w for w in (word,) if w]
                word = ""
            if alone:
                out.append(c)
            elif part:
                small = c.lower()
                word += small if len(small.encode()) == len(c.encode()) and len(small) == 1 else c
        return out + [w for w in (word,) if w]

    rng = random.Random(5)
    texts = ["Hello—world “quoted”", "МОСКВА москва", "你好，世界。再见", "カタカナ漢字 한국어", "x\U0001f600y \U00020000\U00020001", ""]
    for _ in range(300):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x2000, 0x3100), rng.randrange(0x4E00, 0x4E20), rng.randrange(0x10000, 0x20100)])) for _ in range(30)))
    buf, off = text_buffer(pa.array(texts))
    _, start, end, at = words(buf, off)
    low = fold(buf)
    for i, text in enumerate(texts):
        assert [low[start[k] : end[k]].tobytes().decode() for k in range(at[i], at[i + 1])] == brute(text)
    h, _, _, _ = words(*text_buffer(pa.array(["МОСКВА москва ÉTÉ été"])))
    assert h[0] == h[1] and h[2] == h[3]
