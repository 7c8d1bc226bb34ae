import base64
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest_llm import DIR, LONG, ODD

from verdigris.llm import bpe, hilbert, licenses, packing, quality, sharding, toxicity
from verdigris.llm.stage import table
from verdigris.llm.textnum import text_buffer


# License scan.


def matched(found):
    return sorted((r["doc_id"], r["license"], r["matched_words"]) for r in found)


def test_every_license_line_is_found_and_nothing_else(documents, texts):
    found = {r["doc_id"] for r in licenses.license_notices(documents).collect()}
    assert found == {i for i, t in texts.items() if "licen" in t.lower() or "all rights reserved" in t.lower()}


def test_reserved_rights_are_notices_too(documents, texts, make):
    found = {r["doc_id"] for r in licenses.license_notices(documents).collect()}
    assert found == {i for i, t in texts.items() if "licen" in t.lower() or "all rights reserved" in t.lower()}
    full = next(t for name, _, t in licenses.TEMPLATES if name == "Proprietary")
    rows = licenses.license_notices(make([(1, "One line.\nAll rights reserved.\nAnother."), (2, full), (3, "All the rights of others.")])).collect()
    assert matched(rows) == [(1, "Proprietary", 3), (2, "Proprietary", 14)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Distributed under the MIT License", ["MIT"]),
        ("It is available under the MIT License.", ["MIT"]),
        ("Released under the MIT Licence.", ["MIT"]),
        ("Released under the ISC License", ["ISC"]),
        ("Released under the Frog License", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
        ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]),
        ("Licensed under CC BY-NC-ND 3.0", ["CC-BY-NC-ND-3.0"]),
        ("Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.", ["CC-BY-SA-4.0", "CC-BY-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2. There are 3 parts.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3. There are 2 parts.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License v3.", ["GPL"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("Licensed under the Apache License 2.0", ["Apache-2.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under the Mozilla Public License.", ["MPL"]),
    ],
)
def test_names_of_licenses_must_match(make, text, want):
    found = licenses.license_notices(make([(1, "A line before.\n" + text + "\nA line after.")])).collect()
    assert [r["license"] for r in sorted(found, key=lambda r: r["start_word"])] == want


def test_key_words_lose_no_near_miss():
    """Every template with words left out, as many as the coverage allows, has a key word as long as its names stand."""
    rng = np.random.default_rng(3)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for t, (name, _, raw, need, naming) in enumerate(scanner.templates):
        assert need - 1 < licenses.COVERAGE * len(raw) + 1e-6 and need >= licenses.COVERAGE * len(raw) - 1e-6
        fixed = {j for phrase in naming for j in phrase}
        free = [j for j in range(len(raw)) if j not in fixed]
        for _ in range(30):
            away = set(rng.permutation(free)[: len(raw) - need].tolist())
            text = [7, 8, *[11 if j in away else x for j, x in enumerate(raw)], 9]
            assert any(t in scanner.by_key.get(x, []) for x in text), name
            h = np.array(text, np.uint64)
            assert scanner.row(h, np.flatnonzero(np.isin(h, scanner.keys))), name
    assert len(scanner.templates[2][2]) - scanner.templates[2][3] == 12


def test_license_notices_of_odd_rows(make):
    apache = licenses.TEMPLATES[4][2]
    cut = apache.split()
    cut[10:13] = ["mended", "here"]
    docs = make([*ODD, (30, "x " * 50 + "RELEASED under\nthe mit license! Licensed under CC BY-NC 4.0."), (31, " ".join(cut)), (32, "the license of the work is under MIT as released"), (33, LONG + " Released under the MIT License. " + LONG), (34, "Released under the MIT License. " * 2)])
    found = licenses.license_notices(docs).collect()
    assert [(r["doc_id"], r["license"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["start_word"]))] == [(30, "MIT"), (30, "CC-BY-NC-4.0"), (31, "Apache-2.0"), (33, "MIT"), (34, "MIT"), (34, "MIT")]
    assert next(r for r in found if r["doc_id"] == 33)["start_word"] == 60_000
    assert licenses.license_notices(make([])).count() == 0
    assert licenses.license_notices(docs, []).count() == 0


def test_alignment_is_a_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = rng.integers(0, 12, rng.integers(0, 20)).tolist(), rng.integers(0, 12, rng.integers(0, 20)).tolist()
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.align([1, 2, 9, 3, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (3, 2), (4, 3)]


def test_scan_agrees_with_aligning_every_window(texts):
    """Brute force: all windows of all texts, without key words."""
    scanner = licenses.Scanner(licenses.TEMPLATES[:1], licenses.COVERAGE)
    raw = scanner.templates[0][2]
    for i, t in list(texts.items())[:60]:
        h = np.array(licenses.hashes(t), np.uint64)
        hits = np.flatnonzero(np.isin(h, scanner.keys))
        found = bool(scanner.row(h, hits))
        size = len(raw) + len(raw) // 2 + 5
        every = any(len(licenses.align(h[s : s + size].tolist(), raw)) >= licenses.COVERAGE * len(raw) for s in range(len(h)))
        assert found == every, i


# Quality.


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    votes = []
    for right_good, right_bad, silent in ((0.995, 0.8, 0.1), (0.998, 0.6, 0.3), (0.999, 0.7, 0.0), (0.995, 0.5, 0.2)):
        v = np.where(good, rng.random(len(good)) < right_good, rng.random(len(good)) > right_bad).astype(int)
        votes.append(np.where(rng.random(len(good)) < silent, 2, v))
    patterns, which, counts = np.unique(np.stack(votes, 1), axis=0, return_inverse=True, return_counts=True)
    prior, accuracy, post = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.03 and abs(accuracy[0, 0, 0] - 0.8) < 0.05
    assert ((post[which] > 0.5) == good).mean() > 0.95


def test_quality_against_held_out_labels(spark):
    directory = DIR.replace("0.001", "0.01")
    scores = quality.quality_scores(table(spark, directory, "documents")).join(table(spark, directory, "labels").select("doc_id", "quality").withColumnRenamed("quality", "good"), "doc_id").collect()
    kept = [r["keep"] for r in scores if r["good"] == 1]
    dropped = [not r["keep"] for r in scores if r["good"] == 0]
    assert np.mean(kept) > 0.93 and np.mean(dropped) > 0.75


def test_quality_of_odd_rows(make):
    rows = quality.quality_scores(make(ODD)).collect()
    assert len(rows) == len(ODD) - 1
    assert all(r["quality"] == 0 and not r["keep"] for r in rows if r["doc_id"] in (1, 2))
    assert quality.quality_scores(make([])).count() == 0
    assert quality.good_documents(make(ODD)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# Toxicity.


def kernel_weights(s):
    out = {}
    for i in range(len(s)):
        for b in range(2, toxicity.SPAN):
            for a in range(1, b):
                if i + b < len(s) and s[i] and s[i + a] and s[i + b]:
                    k = s[i] << 12 | s[i + a] << 6 | s[i + b]
                    out[k] = out.get(k, 0) + toxicity.DECAY ** (b + 1)
    return out


def test_scores_are_the_normalised_string_kernel():
    rng = np.random.default_rng(2)
    machine = rng.standard_normal(1 << 18).astype(np.float32)
    k = np.arange(1 << 18)
    machine[(k >> 12 == 0) | (k >> 6 & 63 == 0) | (k & 63 == 0)] = 0  # no subsequence holds a gap
    words = ["idiot", "ab", "stupidity", "i", "id*iot", "été", "x" * 40, "abcabcabcabc"]
    code, start, end, _ = toxicity.strings(*text_buffer(pa.array(words)))
    out, begin, _, which = toxicity.distinct(code, start, end)
    value = toxicity.scores(out, begin, machine)[which]
    for k, (a, b) in enumerate(zip(start, end)):
        w = kernel_weights(code[a:b].astype(int).tolist())
        raw = sum(machine[u] * x for u, x in w.items())
        exact = raw / np.sqrt(sum(x * x for x in w.values())) if raw > 0 else raw
        assert value[k] == pytest.approx(exact, rel=1e-3, abs=1e-3)


@pytest.fixture(scope="module")
def trained():
    rng = np.random.default_rng(8)
    pieces = ["the", "on", "er", "ing", "st", "ha", "re", "ed", "ion", "ou"]
    def sentence(toxic):
        w = ["".join(rng.choice(pieces, rng.integers(1, 4))) for _ in range(30)]
        if toxic:
            w[rng.integers(30)] = rng.choice(["idiot", "moron", "scum"])
        return " ".join(w)
    labels = np.array([k % 4 == 0 for k in range(600)]).astype(int)
    texts = [sentence(x) for x in labels]
    return toxicity.train(texts[:400], labels[:400]), texts[400:], labels[400:]


def test_toxicity_on_held_out_sentences(trained):
    (machine, threshold), texts, labels = trained
    got = toxicity.worst(*text_buffer(pa.array(texts)), machine) > threshold
    assert (got == labels).mean() > 0.97


def test_gaps_and_inserted_characters_do_not_hide_an_insult(trained):
    (machine, threshold), _, _ = trained
    value = toxicity.worst(*text_buffer(pa.array(["you i d i o t here", "id*iot", "i.d.i.o.t", "1di0t", "Moron!", "the ring on", ""])), machine)
    assert (value > threshold * 0.8).tolist() == [True] * 5 + [False] * 2


def test_digits_and_splits_do_not_hide_an_insult(trained):
    (machine, threshold), _, _ = trained
    texts = ["you i9d9i9o9t", "an 1d10t", "the id iot here", "mo ron", "a s9c9u9m", "the ring on", "in 1990 and 2024", "a 17 b 35 c"]
    value = toxicity.worst(*text_buffer(pa.array(texts)), machine)
    assert (value > threshold * 0.8).tolist() == [True] * 5 + [False] * 3


def test_joined_strings_have_the_kernel_value():
    rng = np.random.default_rng(4)
    machine = rng.standard_normal(1 << 18).astype(np.float32)
    k = np.arange(1 << 18)
    machine[(k >> 12 == 0) | (k >> 6 & 63 == 0) | (k & 63 == 0)] = 0
    texts = ["id iot", "st up id", "a bb ccc dddd", "one", "", "x  y\nz9z w"]
    code, start, end, at = toxicity.strings(*text_buffer(pa.array(texts)))
    got = {(int(r), round(float(v), 3)) for r, v in zip(*toxicity.joined(code, start, end, at, machine))}
    want = set()
    for r in range(len(texts)):
        for i in range(at[r], at[r + 1]):
            for j in range(i + 1, min(i + toxicity.WINDOW, at[r + 1])):
                w = kernel_weights(code[start[i] : end[j]].astype(int).tolist())
                raw = sum(machine[u] * x for u, x in w.items())
                if raw > 1e-6:
                    want.add((r, round(float(raw / np.sqrt(sum(x * x for x in w.values()))), 3)))
    assert len(got) == len(want) and all(any(r == q and abs(v - u) < 3e-3 for q, u in want) for r, v in got)
    best, pruned = np.zeros(len(texts)), np.zeros(len(texts))
    np.maximum.at(best, *toxicity.joined(code, start, end, at, machine))
    np.maximum.at(pruned, *toxicity.joined(code, start, end, at, machine, np.zeros(len(texts))))
    assert pruned == pytest.approx(best)


def test_labels_without_documents_use_up_no_sample(spark, make):
    ids = range(0, 300)
    docs = make([(k, ("you idiot number " if k % 2 else "the plain ring ") + "abc " * 3) for k in ids])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in [*ids, *range(1_000_000, 1_030_000)]], "doc_id long, quality int, toxic int")
    machine, threshold = toxicity.fit(toxicity.identified(docs), labels, train_toxic=100, train_clean=100)
    assert np.isfinite(threshold) and machine.any()


def test_toxicity_of_odd_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(make(ODD), none).collect()
    assert len(rows) == len(ODD) - 1 and not any(r["toxic"] for r in rows)
    labels = spark.createDataFrame([(4, 1, 1), (8, 1, 0), (8, 1, None), (None, 1, 1), (7, 0, 7)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(make(ODD), labels).count() == len(ODD) - 1
    assert toxicity.toxicity_scores(make([]), labels).count() == 0
    assert toxicity.civil_documents(make(ODD), labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]


# Packing.


def test_hilbert_keys_walk_in_single_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert.hilbert_keys(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_fills_sequences_in_curve_order(documents, texts):
    rows = packing.packed(documents, capacity=500).collect()
    n = {i: len(licenses.hashes(t)) for i, t in texts.items()}
    got, fill = {}, {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["doc_start"], r["n_tokens"]))
        fill.setdefault(r["seq_id"], []).append((r["position"], r["n_tokens"]))
    for i, parts in got.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == n[i]
    assert set(got) == {i for i, k in n.items() if k}
    for s, parts in fill.items():
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == 500 or s == max(fill)
    order = sorted(rows, key=lambda r: (r["seq_id"], r["position"]))
    keys = [(r["curve_key"], r["doc_id"]) for r in order]
    assert keys == sorted(keys)


def test_packing_of_odd_rows(make):
    rows = packing.packed(make(ODD), capacity=100).collect()
    assert sum(r["n_tokens"] for r in rows) == 1 + 60_000 + 1 + 3 + 3
    assert packing.packed(make([])).count() == 0


# BPE.


def test_bpe_matches_a_known_encoder(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    known = tiktoken.Encoding("known", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    some = [*texts.values(), "", "a", "  \n\n x", "안녕😀 world " * 50, "a" * 3000, "<|endoftext|>", "it's we'll"]
    ids, n = bpe.Encoder(bpe.VOCABULARY).encode(some)
    at = np.append(0, np.cumsum(n))
    for k, t in enumerate(some):
        assert ids[at[k] : at[k + 1]].tolist() == known.encode_ordinary(t)


def test_bpe_round_trip_of_odd_rows(make):
    docs = make(ODD)
    rows = bpe.encoded(docs)
    assert all(r["round_trip"] for r in rows.collect()) and rows.count() == len(ODD) - 1
    back = sorted((r["doc_id"], r["text"]) for r in bpe.decoded(rows).collect())
    assert back == sorted((i, t or "") for i, t in ODD if i is not None)
    assert bpe.encoded(make([])).count() == 0


# Sharding.


@pytest.mark.parametrize("limit", [sharding.SHARD_BYTES, 20_000, 3_000, 10])
def test_sharding_matches_sql(documents, limit):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = sorted(con.execute(sharding.oracle(limit)).fetchall())
    assert sorted(tuple(r) for r in sharding.sharded(documents, limit).collect()) == want


def test_sharding_of_odd_rows(make):
    rows = sharding.sharded(make(ODD), 100).collect()
    assert len(rows) == len(ODD) - 1
    assert len({r["shard"] for r in rows if r["doc_id"] == 8}) == 1
    big = next(r for r in rows if r["doc_id"] == 5)
    assert big["depth"] == sharding.HASH_BITS and big["shard_bytes"] >= len(LONG)
    assert all(r["shard_bytes"] <= 100 for r in rows if r["doc_id"] not in (5, 7))
    assert sharding.sharded(make([])).count() == 0


def test_long_pieces_of_bytes_match_a_known_encoder():
    rng = np.random.default_rng(8)
    vocabulary = bpe.vocabulary(bpe.VOCABULARY)
    for n in (513, 2000, 20_000):
        for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "ABCXYZabcxyz019+/", "-=_*"):
            piece = "".join(rng.choice(list(alphabet), n)).encode()
            row = np.frombuffer(piece, np.uint8)
            ids = vocabulary._merge_long(row)
            assert vocabulary.decode(ids).tobytes() == piece
            if n <= 2000:
                assert np.array_equal(ids, vocabulary._merge(row, np.array([0]), np.array([n]))[0])


def test_expectation_maximisation_needs_no_bound_on_false_alarms():
    """Labellers that accuse many good documents too, against a step of EM written out document by document."""
    rng = np.random.default_rng(4)
    good = rng.random(40_000) < 0.7
    votes = np.stack([np.where(good, rng.random(len(good)) < a, rng.random(len(good)) > b).astype(int) for a, b in ((0.9, 0.8), (0.85, 0.75), (0.93, 0.6), (0.8, 0.85), (0.95, 0.7))], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, accuracy, post = quality.estimate(patterns, counts.astype(float), 2000)
    assert abs(prior - 0.7) < 0.05
    assert np.abs(accuracy[1, :, 1] - [0.9, 0.85, 0.93, 0.8, 0.95]).max() < 0.04
    assert np.abs(accuracy[0, :, 0] - [0.8, 0.75, 0.6, 0.85, 0.7]).max() < 0.06
    weight = {tuple(p): (n, q) for p, n, q in zip(patterns.tolist(), counts, post)}
    for k in range(5):
        bad = [(1 - q) * n for p, (n, q) in weight.items() if p[k] == 0]
        every = [(1 - q) * n for n, q in weight.values()]
        assert abs((sum(bad) + 1) / (sum(every) + 2) - accuracy[0, k, 0]) < 1e-3
    for p, (n, q) in weight.items():
        odds = prior / (1 - prior)
        for k, v in enumerate(p):
            odds *= accuracy[1, k, v] / accuracy[0, k, v]
        assert abs(odds / (1 + odds) - q) < 1e-3


def test_decisions_of_the_scorer_match_counting_trigrams():
    rng = np.random.default_rng(6)
    weights = rng.standard_normal(quality.SLOTS + 1).astype(np.float32)
    texts = ["", "ab", "abc", "hello hello hello", "\u00e9" * 40] + ["".join(rng.choice(list("abc de\n"), rng.integers(0, 300))) for _ in range(60)]
    got = quality.decisions(*text_buffer(pa.array(texts)), weights)
    for text, value in zip(texts, got):
        b = text.encode()
        slots = Counter(((b[i] * 65599 + b[i + 1]) * 65599 + b[i + 2]) * 2654435761 % 2**32 >> 20 for i in range(len(b) - 2))
        want = sum(np.sqrt(n / (len(b) - 2)) * float(weights[k]) for k, n in slots.items()) + float(weights[-1])
        assert abs(want - value) < 1e-6


def test_short_rows_take_little_memory():
    text = pa.array(["ab cd"] * 10_000)
    weights = np.zeros(quality.SLOTS + 1, np.float32)
    tracemalloc.start()
    quality.decisions(*text_buffer(text), weights)
    for _, _, buf, off in quality._few_rows(text, quality._TABLE // (8 * quality.SLOTS)):
        assert len(off) <= 513
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_every_template_is_found_where_it_stands(number):
    """Whole templates between other words: the span, the coverage, and no notice in the words around."""
    name, kind, text = licenses.TEMPLATES[number]
    raw = licenses.hashes(text)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    around = licenses.hashes(" ".join(f"plain{k}" for k in range(40)))
    h = np.array(around + raw + around, np.uint64)
    hits = np.flatnonzero(np.isin(h, scanner.keys))
    rows = scanner.row(h, hits)
    assert len(rows) == 1
    _, _, start, end, matched, coverage = rows[0]
    assert start >= 40 and end <= 40 + len(raw) and matched >= 0.8 * len(raw)
    # By brute force: no template matches more of these words than the one reported.
    most = max(len(licenses.align(raw, licenses.hashes(t))) for n, _, t in licenses.TEMPLATES if n == rows[0][0])
    assert matched == most


def test_prose_about_licenses_is_no_notice(make):
    prose = "We talked about the license of the new library for an hour. Some prefer permissive terms, others want every change to be shared. Redistribution of binaries came up as well, and who is liable for damages."
    assert licenses.license_notices(make([(1, prose), (2, prose * 50)])).count() == 0


def test_the_folded_machine_decides_as_the_kernel_matrix_does():
    """A machine folded from landmarks and coefficients has the value of the sum over explicit kernel values."""
    rng = np.random.default_rng(12)
    letters = "abcdeiost"
    texts = ["".join(rng.choice(list(letters), rng.integers(4, 11))) for _ in range(12)]
    marks, alpha = texts[:5], rng.standard_normal(5)
    maps = {t: kernel_weights([ord(c) - 96 for c in t]) for t in texts}
    unit = {t: {k: v / np.sqrt(sum(x * x for x in m.values())) for k, v in m.items()} for t, m in maps.items()}
    machine = np.zeros(1 << 18, np.float32)
    for t, a in zip(marks, alpha):
        for k, v in unit[t].items():
            machine[k] += a * v
    for t in texts:
        explicit = sum(a * sum(v * unit[m].get(k, 0) for k, v in unit[t].items()) for m, a in zip(marks, alpha))
        code, start, end, at = toxicity.strings(*text_buffer(pa.array([t])))
        out, begin, _, _ = toxicity.distinct(code, start, end)
        value = toxicity.scores(out, begin, machine)[0]
        assert (value > 0) == (explicit > 1e-9)
        if explicit > 1e-9:
            assert abs(value - explicit) < 1e-4
