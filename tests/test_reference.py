import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as tx
from verdigris.operators import batching, glossary, paths, placeholders, pool, translate, usage
from verdigris.operators import catalog as cat
from verdigris.operators.segment import blocks, segment, slug
from verdigris.plans import engine
from verdigris.sources import documents, po

SAMPLE = """# Intro

First words here.

## Begin

- one
- two
  nested words

### Setup

```sh
run it
```

Then a line.

| a | b |
|---|---|
| 1 | 2 |

> quoted
> more

---

1. first
2. second

Last words.
"""


def shape(text):
    return [(b["type"], b["start"], b["end"], b["msgctxt"]) for b in segment(text.splitlines())]


def test_sample_has_one_block_of_every_type():
    top = "intro/begin/setup"
    assert shape(SAMPLE) == [
        ("heading", 0, 1, "intro::heading:0"),
        ("para", 2, 3, "intro::para:0"),
        ("heading", 4, 5, "intro/begin::heading:0"),
        ("ulist", 6, 9, "intro/begin::ulist:0"),
        ("heading", 10, 11, f"{top}::heading:0"),
        ("code", 12, 15, f"{top}::code:0"),
        ("para", 16, 17, f"{top}::para:0"),
        ("table", 18, 21, f"{top}::table:0"),
        ("quote", 22, 24, f"{top}::quote:0"),
        ("hr", 25, 26, f"{top}::hr:0"),
        ("olist", 27, 29, f"{top}::olist:0"),
        ("para", 30, 31, f"{top}::para:1"),
    ]


@pytest.mark.parametrize(
    "lines, paths",
    [
        (["# P one", "## Q", "### R"], ["p-one", "p-one/q", "p-one/q/r"]),
        (["# Up", "## In", "# Over", "## Out"], ["up", "up/in", "over", "over/out"]),
        (["# Same", "## Same"], ["same", "same/same"]),
        (["# Same", "# Same"], ["same", "same-1"]),
        (["# P", "### R", "### S"], ["p", "p/r", "p/r/s"]),
    ],
)
def test_heading_paths(lines, paths):
    assert ["/".join(b["path"]) for b in segment(lines)] == paths


@pytest.mark.parametrize(
    "lines, kinds",
    [
        (["```", "a", "b"], [("code", 0, 3)]),
        (["- Over", "  - Under it", "- Next"], [("ulist", 0, 3)]),
        (["- a", "", "- b", "", "text"], [("ulist", 0, 3), ("para", 4, 5)]),
        (["- a", "1. b"], [("ulist", 0, 1), ("olist", 1, 2)]),
        (["- a", "", "1. b"], [("ulist", 0, 1), ("olist", 2, 3)]),
        (["- a", "goes on", "# H"], [("ulist", 0, 2), ("heading", 2, 3)]),
        (["---", "***", "___", "- - -"], [("hr", k, k + 1) for k in range(4)]),
        (["", "  "], []),
        (["text", "> quote", "text"], [("para", 0, 1), ("quote", 1, 2), ("para", 2, 3)]),
    ],
)
def test_grammar(lines, kinds):
    assert [(b["type"], b["start"], b["end"]) for b in segment(lines)] == kinds


def test_slugs_agree_in_python_and_in_columns(spark):
    titles = ["Über Café 안녕!", "a  b - c", "***", "A_b 1"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(tx.slug(F.col("t"))).collect()] == [slug(t) for t in titles] == ["über-café-안녕", "a-b---c", "section", "a_b-1"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], cat.CATALOG)


def stored(df):
    """The same rows without their plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_unchanged_documents_ask_nothing_and_one_edit_asks_one(spark):
    texts = [SAMPLE, "# T\n\nOne.\n\nTwo.\n"]
    first = engine.run(docs(spark, *texts), empty(spark), engine.Config())
    catalog = stored(first.catalog)
    assert first.answers.agg(F.sum("calls")).first()[0] == 2
    out = {r["doc_id"]: r["text"] for r in first.documents.collect()}
    assert out[1] == "[T] # T\n\n[T] One.\n\n[T] Two.\n" and "\n---\n" in out[0]
    assert engine.run(docs(spark, *texts), catalog, engine.Config()).answers.count() == 0
    edited = engine.run(docs(spark, SAMPLE, "# T\n\nOne!\n\nTwo.\n"), catalog, engine.Config())
    assert [r["source"] for r in edited.answers.collect()] == ["One!"]
    removed = engine.run(docs(spark, SAMPLE, "# T\n\nOne.\n"), catalog, engine.Config())
    assert removed.answers.count() == 0 and removed.catalog.where("doc_id = 1").count() == 2


def test_every_result_of_a_run_shares_one_set_of_calls(spark, tmp_path):
    log = str(tmp_path / "calls")

    def batch(payload):
        with open(log, "a") as f:
            f.write("call\n")
        return translate.echo(payload)

    out = engine.run(docs(spark, "# T\n\nOne.\n"), empty(spark), engine.Config(batch=batch))
    assert out.documents.count() == 1 and out.catalog.count() == 2 and out.answers.count() == 2 and out.coverage.count() == 2
    assert open(log).read() == "call\n"


def test_refining_comes_before_translating(spark):
    polished, made = engine.refine_first(docs(spark, "One.\n"), empty(spark), empty(spark), engine.Config(), "en")
    assert polished.documents.first()["text"] == "[T] One.\n" and made.documents.first()["text"] == "[T] [T] One.\n"
    with pytest.raises(ValueError):
        engine.refine_first(docs(spark, "x"), empty(spark), empty(spark), engine.Config(), "")


def test_receipt_text():
    text = usage.rendered({"model": "m", "api_calls": 1200, "input_tokens": 5, "output_tokens": 6, "total_tokens": 11, "input_cost": 0.5, "output_cost": None, "total_cost": None})
    assert "1,200" in text and "$0.500000" in text and "—" in text


def test_failed_validation_leaves_the_entry_fuzzy_and_empty(spark):
    strip = lambda payload: json.dumps({k: v.lstrip("# ") for k, v in json.loads(payload).items()})
    out = engine.run(docs(spark, "# Head\n\nText.\n"), empty(spark), engine.Config(batch=strip, validation="conservative"))
    rows = {r["msgid"]: r for r in out.catalog.collect()}
    assert rows["# Head"]["fuzzy"] and rows["# Head"]["msgstr"] == "" and rows["Text."]["msgstr"] == "Text."
    assert out.documents.first()["text"] == "# Head\n\nText.\n"


def test_wrong_settings_are_refused():
    for bad in ({"mode": "x"}, {"validation": "x"}, {"glossary_mode": "x"}):
        with pytest.raises(ValueError):
            engine.Config(**bad)


def test_glossary_terms_come_back_in_the_target_form(spark):
    config = engine.Config(batch=lambda p: p, glossary={"API": None, "server": "Server-de"})
    out = engine.run(docs(spark, "The API of a server.\n"), empty(spark), config)
    assert out.documents.first()["text"] == "The API of a Server-de.\n"


def test_one_call_serves_all_languages(spark):
    batch = lambda p: json.dumps({k: {"ko": "K " + v, "ja": "J " + v, "xx": "no"} for k, v in json.loads(p).items()})
    none = spark.createDataFrame([], cat.CATALOG + ", lang string")
    rows = engine.run_multi(docs(spark, "# T\n\nOne.\n"), none, batch, ["ko", "ja", "ko"]).collect()
    assert {(r["lang"], r["msgstr"]) for r in rows} == {("ko", "K # T"), ("ko", "K One."), ("ja", "J # T"), ("ja", "J One.")}
    with pytest.raises(ValueError):
        engine.run_multi(docs(spark, "x"), none, batch, [])


def test_batches_bisect_and_ask_again():
    def fussy(payload):
        items = json.loads(payload)
        if len(items) > 2:
            return "sorry"
        return "```json\n" + json.dumps({k: v for k, v in items.items() if v != "lost"}) + "\n```"

    worker = translate.BatchTranslator(fussy)
    assert worker.translate({"a": "1", "b": "lost", "c": "3", "d": "4"}) == {"a": "1", "c": "3", "d": "4"}
    assert worker.calls == 3
    assert translate.salvage('Sure: {"a": 1} done') == {"a": 1} and translate.salvage("[1]") == {}


def test_groups_respect_sizes_and_sections(spark):
    text = "".join(f"# {s}\n\n{s} one.\n\n{s} two.\n\n" for s in "AB")
    found = cat.reordered(cat.sync(blocks(docs(spark, text)), empty(spark)))
    sizes = batching.section_groups(found, 4).groupBy("group_no").count().orderBy("group_no").collect()
    assert [r["count"] for r in sizes] == [3, 3]
    assert [r["count"] for r in batching.section_groups(found, 40, 5).groupBy("group_no").count().collect()] == [1] * 6


def test_pool_ranks_similar_earlier_pairs(spark):
    rows = [(0, k, f"c{k}", t, t.upper(), False, False) for k, t in enumerate(["the quick brown fox", "completely different text", "the quick brown dog"])]
    catalog = spark.createDataFrame([*rows, (0, 3, "c3", "the quick brown cat", "", False, False)], cat.CATALOG)
    best = pool.references(cat.pending(catalog), cat.pool_seed(catalog), 2).orderBy("rank").collect()
    assert [r["src"] for r in best] == ["the quick brown fox", "the quick brown dog"]


def test_glossary_cascade(spark):
    files = spark.createDataFrame([("a/b/x.md",), ("y.md",)], "rel_path string")
    levels = glossary.levels(spark, {"": '{"API": {"ko": "p-ko", "ja": "p-ja"}, "X": "x", "Y": null}', "a": '{"API": {"ko": "c-ko"}, "X": "__remove__"}', "a/b": '{"Y": "why"}', "c": "not json"})
    got = {(r["rel_path"], r["term"]): (r["ko"], r["ja"]) for r in glossary.resolved(glossary.resolved(glossary.cascaded(files, levels), F.lit("ko")).withColumnRenamed("replacement", "ko"), F.lit("ja")).withColumnRenamed("replacement", "ja").collect()}
    assert got == {("a/b/x.md", "API"): ("c-ko", "p-ja"), ("a/b/x.md", "Y"): ("why", "why"), ("y.md", "API"): ("p-ko", "p-ja"), ("y.md", "X"): ("x", "x"), ("y.md", "Y"): (None, None)}


def test_placeholders_keep_protected_spans(spark):
    text = '## A {#a}\n\n<a href="/x" class=\'k\'>t</a> `{#code}` ⟦P:0⟧\n'
    encoded, items = placeholders.effective().encode(text)
    assert [(i[1], i[2]) for i in items] == [("{#a}", "anchor"), ('href="/x"', "html_attr"), ("class='k'", "html_attr"), ("⟦P:0⟧", "__literal__")]
    assert items[0][0] == "⟦P:1⟧" and "{#code}" in encoded
    one = spark.createDataFrame([(text,)], "t string").withColumn("e", placeholders.encode(F.col("t"), placeholders.effective()))
    assert one.select(placeholders.decode(F.col("e.encoded"), F.col("e.map"))).first()[0] == text
    pick = placeholders.Registry()
    pick.register("short", "a")
    pick.register("long", "abc")
    pick.register("none", "x*")
    assert [i[2] for i in pick.encode("abc")[1]] == ["long"]


@pytest.mark.parametrize(
    "source, decoded, issue",
    [
        ("## A {#a}\n## B {#b}", "## A {#b}\n## B {#a}", ["anchor_heading_drift"]),
        ("## A {#a}\ntext", "## A\ntext {#a}", ["anchor_heading_drift", "anchor_offheading_count"]),
        ("<a class=x>1</a> <a class=y id=z>2</a>", "<a class=y>1</a> <a class=x id=z>2</a>", ["html_attr_tag_drift"]),
        ("<img src=a><source src=b>", "<img src=b><source src=a>", ["html_attr_tag_drift"]),
        ("<a href=/a>A</a> <a href=/b>B</a>", "<a href=/b>B</a> <a href=/a>A</a>", []),
    ],
)
def test_placements(source, decoded, issue):
    assert placeholders.drift(source, decoded) == issue


@pytest.mark.parametrize(
    "source, output, refine, want",
    [
        ("## Section", "### 섹션", False, ["heading_level"]),
        ("```\na\n```\n```\nb\n```", "```\n가\n```", False, ["fence_count"]),
        ("Call the API endpoint.", "에이피아이 호출", False, ["glossary_preserve"]),
        ("Hello world", "Hello world (translated)", False, ["target_language"]),
        ("OpenAI models", "OpenAI models", False, []),
        ("Reset the password", "Reset the password", False, ["target_language"]),
        ("Use `a` and `b`", "사용", False, ["inline_code_count"]),
        ("Reset the password (비밀번호)", "비밀번호를 재설정", True, ["language_stability"]),
        ("Use the 漢 character in names.", "Use the character in names.", True, []),
    ],
)
def test_validation(spark, source, output, refine, want):
    df = spark.createDataFrame([(source, output)], "s string, o string")
    found = tx.issues(F.col("s"), F.col("o"), F.lit("ko"), F.lit(True), F.lit(refine), F.array(F.lit("API")))
    assert df.select(found).first()[0] == want


def test_paths_and_prices(spark):
    e = spark.createDataFrame([("", "a", "same"), ("", "b", "Same"), ("", "c", "same-2"), ("x", "a", "same")], "parent string, segment string, slug string")
    assert {(r["parent"], r["segment"]): r["name"] for r in paths.disambiguated(e).collect()} == {("", "a"): "same", ("", "b"): "Same-2", ("", "c"): "same-2-2", ("x", "a"): "same"}
    raw = spark.createDataFrame([("CON.txt", "r"), (" a:b? ", "r"), ("..", "r"), (None, "a b"), ("..", "??")], "t string, r string")
    # Where nothing of the translation is left, the segment's own slug serves, and a hash only where that is empty too.
    assert [r[0] for r in raw.select(paths.segment_name(F.col("t"), F.col("r"))).collect()] == ["CON_.txt", "ab", "r", "a-b", "segment-" + __import__("hashlib").sha1(b"??").hexdigest()[:8]]
    calls = spark.createDataFrame([("p/m", "10", "5"), ("p/m", "x", None), ("q", "1", "1")], "model string, input_tokens string, output_tokens string")
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_rate double, output_rate double")
    got = {r["model"]: (r["api_calls"], r["input_tokens"], r["total_cost"]) for r in usage.receipts(calls, prices).collect()}
    assert got == {"p/m": (2, 10, 0.00004), "q": (1, 1, None)}


def test_catalog_files_round_trip(tmp_path):
    entries = [{"msgctxt": "a::para:0", "msgid": 'two\nlines "q" \\ \t', "msgstr": "x\n", "flags": ["fuzzy"], "tcomment": "why", "obsolete": False}, {"msgctxt": "b", "msgid": "old", "msgstr": "", "flags": [], "tcomment": "", "obsolete": True}]
    path = str(tmp_path / "d" / "c.po")
    po.save(path, entries, {"Language": "ko"})
    found, metadata = po.load_or_create(path, "ja")
    assert found == entries and metadata["Language"] == "ko"
    assert po.load_or_create(str(tmp_path / "none.po"), "ja") == ([], {"Content-Type": po.PLAIN, "Language": "ja"})
    with pytest.raises(ValueError):
        po.load_or_create(None)


def test_directories_scan_and_write(spark, tmp_path):
    for name, text in (("a b/x.md", "# X\r\n\r\ntext"), ("y.md", ""), ("z.txt", "no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(text.encode())
    found = documents.scan(spark, str(tmp_path / "in"))
    assert {(r["rel_path"], r["text"]) for r in found.collect()} >= {("a b/x.md", "# X\n\ntext")}
    documents.write(found, str(tmp_path / "out"))
    assert Path(tmp_path / "out" / "a b" / "x.md").read_text() == "# X\n\ntext"


def test_stream_keeps_the_catalog_in_step(spark, tmp_path):
    from verdigris.streaming.resync import resync

    def send(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        resync(spark, changes, str(tmp_path / "catalog"), str(tmp_path / "state")).awaitTermination()

    send("1", [(1, "# A\n\none"), (2, "# B")])
    send("2", [(1, "# A\n\ntwo")])
    rows = spark.read.schema(cat.CATALOG).parquet(str(tmp_path / "catalog" / "v=1")).collect()
    assert {(r["doc_id"], r["msgid"], r["fuzzy"]) for r in rows} == {(1, "# A", False), (1, "two", True), (2, "# B", False)}


def test_blocks_leave_the_worker_in_small_batches():
    from verdigris.operators.segment import OUT_CHARS, _segment, text_blocks

    text = "\n\n".join(f"line {k} " + "x" * 5000 for k in range(100))
    given = pa.record_batch([pa.array(range(40)), pa.array([text] * 38 + [None, ""])], names=["doc_id", "text"])
    made = list(_segment(iter([given, given]), None, text_blocks))
    assert max(sum(map(len, b.column("text").to_pylist())) for b in made) <= OUT_CHARS + 6000
    assert [(d, s) for b in made for d, s in zip(b.column("doc_id").to_pylist(), b.column("seq").to_pylist())] == [(d, s) for d in range(38) for s in range(100)] * 2


def test_only_texts_that_composition_may_change_reach_python(spark, monkeypatch, tmp_path):
    import unicodedata

    texts = [None, "", "abc", "caf\u00e9 \u02ff", "cafe\u0301", "\u1112\u1161\u11ab", "\u212b x", "a\u0323\u0302", "\ud55c\uae00", "\U0001f600 e\u0300"]

    def seen(text):
        if text is not None:
            with open(tmp_path / "seen", "a", encoding="utf-8") as f:
                f.write(text + "\n")
        return None if text is None else unicodedata.normalize("NFC", text)

    monkeypatch.setattr(paths, "_nfc", seen)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", paths.nfc(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in sorted(rows)] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert set((tmp_path / "seen").read_text(encoding="utf-8").split("\n")) - {""} == {t for t in texts if t and max(t) >= "\u0300"}


def test_similar_pairs_are_those_of_difflib():
    import random
    from difflib import SequenceMatcher

    from verdigris.operators.ratio import Text

    rng = random.Random(7)
    words = ["the", "of", "river", "Ünder", "quick", "zebra", "a", "translation", "e\u0301", "\U0001f600", "한글", "x", "jump"]

    def line(most: int) -> str:
        text = " ".join(rng.choices(words, k=rng.randrange(most)))
        return text if rng.random() < 0.7 else "".join(rng.choices("ab c", k=len(text)))

    def near(text: str) -> str:
        at = rng.randrange(len(text) + 1)
        return text[:at] + rng.choice(["", "q", "the river"]) + text[at + rng.randrange(9) :]

    for most in (3, 12, 40, 90, 300):
        texts = [line(most) for _ in range(14)]
        texts += [near(t) for t in texts[:8]] + texts[:4] + ["", "x" * 199, "x" * 200, "ab" * 120]
        made = pool.Pool([(t, f"[{k}]") for k, t in enumerate(texts)])
        for n, query in enumerate([*texts[:6], near(texts[7]), line(most), ""]):
            ratio = {t: SequenceMatcher(None, query, t).ratio() for t in set(texts)}
            for t in set(texts):
                if query or t:
                    assert 2.0 * Text(t).matched(query, 0) / (len(query) + len(t)) == ratio[t]
            want = sorted(((ratio[t], -k) for k, t in enumerate(made.pairs) for t in [t[0]] if t != query), reverse=True)[:5]
            assert made.similar(query) == [(s, *made.pairs[-k]) for s, k in want]
            made.add(near(query), f"[new {n}]")
            texts.append(made.pairs[-1][0])


def test_rebuilt_counts_lines_as_the_blocks_do(spark):
    texts = ["a\x0cb\n\nc\n", "a\r\n\r\nb\rc\r\r\nd", "# t\x85\nx \n\ny z\n\n---\n\nend", "\x1c\n\np\x1dq\x1e\x0b\n\nr\x00s", "a\n\n\nb\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = blocks(docs)
    done = found.where("text <> 'c'").select("doc_id", F.col("seq").alias("ord"), "msgctxt", F.col("text").alias("msgid"), F.concat(F.lit("T "), "text").alias("msgstr"), F.lit(False).alias("fuzzy"), F.lit(False).alias("obsolete"))
    got = {r["doc_id"]: r["text"] for r in cat.rebuilt(found, done, docs).collect()}
    for k, text in enumerate(texts):
        lines = text.splitlines(keepends=True)
        at, want = 0, ""
        for b in segment([x.rstrip("\n") for x in lines]):
            own = "".join(lines[b["start"] : b["end"]]) if b["type"] == "hr" or b["text"] == "c" else f"T {b['text']}\n"
            want, at = want + "".join(lines[at : b["start"]]) + own, b["end"]
        assert got[k] == want + "".join(lines[at:])
