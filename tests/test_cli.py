"""The command line: files, folders, several languages, glossaries, paths, receipts and refusals."""

import json

import pytest

from verdigris.__main__ import main
from verdigris.plans import engine
from verdigris.sources import po


def note(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def shown(capsys):
    out = capsys.readouterr().out
    return json.loads(out[out.index("{") :])


def test_one_file_and_its_second_run(spark, tmp_path, capsys):
    source, target = note(tmp_path / "a.md", "# T\n\nOne.\n"), str(tmp_path / "out" / "a.md")
    receipt = tmp_path / "r" / "receipt.json"
    assert main(["translate", source, target, "--target", "ko", "--json-receipt", str(receipt)]) == 0
    found = shown(capsys)
    assert found["translation_stats"]["processed"] == 2 and found["translation_stats"]["api_calls"] == 1
    assert (tmp_path / "out" / "a.md").read_text() == "[T] # T\n\n[T] One.\n"
    entries, head = po.loads((tmp_path / "out" / "a.po").read_text())
    assert [e["msgstr"] for e in entries] == ["[T] # T", "[T] One."] and head["Language"] == "ko" and "POT-Creation-Date" in head
    assert json.loads(receipt.read_text())["api_calls"] == 1
    assert main(["translate", source, target, "--target", "ko"]) == 0
    assert shown(capsys)["translation_stats"]["api_calls"] == 0
    assert main(["report", source, str(tmp_path / "out" / "a.po")]) == 0
    assert "translated 2 (100.0 %)" in capsys.readouterr().out
    assert main(["estimate", source]) == 0
    assert shown(capsys)["pending"] == 2


def test_refining_first_writes_both_texts(spark, tmp_path):
    source = note(tmp_path / "a.md", "One.\n")
    args = ["translate", source, str(tmp_path / "t.md"), "--target", "ko", "--refine-first", "--refined-path", str(tmp_path / "r.md"), "--refine-lang", "en"]
    assert main(args) == 0
    assert (tmp_path / "r.md").read_text() == "[T] One.\n" and (tmp_path / "t.md").read_text() == "[T] [T] One.\n"
    assert (tmp_path / "r.po").exists() and (tmp_path / "t.po").exists()


def test_folders_have_glossaries_catalogs_and_names(spark, tmp_path, capsys):
    src = tmp_path / "src"
    note(src / "guide" / "intro.md", "Use the API.\n")
    note(src / "guide" / "setup.md", "---\n")
    note(src / "top.md", "A server.\n")
    note(src / "glossary.json", json.dumps({"server": {"ko": "KO-SERVER"}}))
    note(src / "guide" / "glossary.json", json.dumps({"API": None}))
    args = ["translate-dir", str(src), str(tmp_path / "out"), "--target", "ko", "--translate-paths"]
    assert main(args) == 0
    found = shown(capsys)
    assert (found["files_processed"], found["files_failed"], found["files_skipped"]) == (2, 0, 1)
    made = json.loads((tmp_path / "out" / "path_map.json").read_text())
    assert set(made) == {"guide/intro.md", "guide/setup.md", "top.md"} and all(t.endswith(".md") for t in made.values())
    assert (tmp_path / "out" / made["top.md"]).read_text() == "[T] A KO-SERVER.\n"
    assert (tmp_path / "out" / made["guide/intro.md"]).read_text() == "[T] Use the API.\n"
    assert po.loads((tmp_path / "out" / "guide" / "intro.po").read_text())[0][0]["msgstr"] == "[T] Use the API."
    (src / "top.md").unlink()
    assert main(args) == 0
    assert shown(capsys)["files_processed"] == 0
    assert not (tmp_path / "out" / made["top.md"]).exists() and (tmp_path / "out" / made["guide/intro.md"]).exists()


def test_languages_of_one_file(spark, tmp_path, capsys):
    source = note(tmp_path / "a.md", "One.\n")
    # The echo answers with texts, not with one for each language, so every language is asked for by itself.
    assert main(["translate-multi", source, "--langs", "ko, ja,ko", "--target-template", str(tmp_path / "{lang}" / "a.md")]) == 0
    assert shown(capsys)["target_langs"] == ["ko", "ja"]
    assert all((tmp_path / x / "a.md").read_text() == "[T] One.\n" and (tmp_path / x / "a.po").exists() for x in ("ko", "ja"))


@pytest.mark.parametrize(
    "args",
    [
        ["translate", "{s}", "{s}", "--target", "ko"],
        ["refine", "{s}", "{d}/r.md", "--target", "en", "--inplace"],
        ["refine-dir", "{d}", "{d}", "--target", "en"],
        ["translate", "{s}", "{d}/t.md", "--target", "ko", "--refine-first"],
        ["translate", "{s}", "{d}/t.md", "--target", "ko", "--refine-first", "--refined-path", "{d}/r.md"],
        ["translate", "{s}", "{d}/t.md", "--target", "ko", "--refine-first", "--refined-path", "{d}/t.md", "--refine-lang", "en"],
        ["translate", "{s}", "{d}/t.md", "--target", "ko", "--model", "some/model"],
        ["translate", "{d}/none.md", "{d}/t.md", "--target", "ko"],
        ["translate-multi", "{s}", "--langs", " , ", "--target-template", "{d}/{{lang}}.md"],
        ["translate-multi", "{s}", "--langs", "ko", "--target-template", "{d}/t.md"],
        ["translate-multi", "{s}", "--langs", "ko", "--target-template", "{d}/{{lang}}{{version}}.md"],
    ],
)
def test_wrong_usage_ends_with_2(spark, tmp_path, args):
    s = note(tmp_path / "a.md", "One.\n")
    assert main([x.format(s=s, d=tmp_path) for x in args]) == 2


def test_nearest_glossary_wins_for_one_file():
    levels = ['{"a": {"ko": "1", "ja": "2"}, "b": "x", "c": null}', '{"a": {"ko": "3"}, "b": "__remove__"}']
    assert engine.glossary_of(levels, None, "ko") == {"a": "3", "c": None}
    assert engine.glossary_of(levels, {"b": "named"}, "ja") == {"a": "2", "c": None, "b": "named"}


def test_messages_carry_pairs_glossary_and_rules(spark, tmp_path):
    from pyspark.sql import functions as F

    from verdigris.operators import catalog as cat

    log = str(tmp_path / "log")

    def chat(messages, options):
        with open(log, "a") as f:
            f.write(json.dumps(messages) + "\n")
        return {"text": json.dumps({k: "X " + v for k, v in json.loads(messages[-1]["content"]).items()}), "usage": {"prompt_tokens": 7, "completion_tokens": True}}

    config = engine.Config(chat=chat, target_lang="ko", glossary_mode="instruction", glossary={"API": None, "zzz": "no"}, extra_instructions="Be brief.")
    docs = spark.createDataFrame([(1, "The API one.\n\nThe API two.\n")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0, "::para:0", "The API one.", "Earlier.", False, False)], cat.CATALOG)
    out = engine.run(docs, known, config)
    assert out.documents.first()["text"] == "Earlier.\n\nX The API two.\n"
    system, user = json.loads(open(log).read())
    assert "Earlier." in system["content"] and '"API"' in system["content"] and "zzz" not in system["content"] and "Be brief." in system["content"]
    assert list(json.loads(user["content"]).values()) == ["The API two."]
    assert out.statistics()["input_tokens"] == 7 and out.statistics()["output_tokens"] == 0
    assert out.answers.agg(F.sum("calls")).first()[0] == 1
