"""Gettext catalogs: a small codec, and tables of their entries."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import CATALOG
from . import documents

PLAIN = "text/plain; " + "charset=UTF-8"
COMMENTED = f"{CATALOG}, tcomment string"
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\"}
_FIELD = re.compile(r'(?:#~ )?(msgctxt|msgid|msgstr)?\s*"(.*)"\s*$')


def _quote(text: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = text.replace(a, b)
    return f'"{text}"'


def _field(name: str, text: str, mark: str) -> list[str]:
    lines = text.split("\n")
    parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    if len(parts) < 2:
        return [f"{mark}{name} {_quote(text)}"]
    return [f'{mark}{name} ""', *(mark + _quote(x) for x in parts)]


def dumps(entries: list[dict], metadata: dict[str, str] | None = None) -> str:
    """Text of a catalog; entries have msgctxt, msgid, msgstr, flags, tcomment and obsolete."""
    head = {"Content-Type": PLAIN} | (metadata or {})
    out = ["\n".join(_field("msgid", "", "") + _field("msgstr", "".join(f"{k}: {v}\n" for k, v in head.items()), ""))]
    for e in entries:
        mark = "#~ " if e.get("obsolete") else ""
        lines = [f"# {x}" for x in (e.get("tcomment") or "").split("\n") if x]
        if e.get("flags"):
            lines.append("#, " + ", ".join(e["flags"]))
        for name in ("msgctxt", "msgid", "msgstr"):
            if name != "msgctxt" or e.get(name) is not None:
                lines += _field(name, e.get(name) or "", mark)
        out.append("\n".join(lines))
    return "\n\n".join(out) + "\n"


def loads(text: str) -> tuple[list[dict], dict[str, str]]:
    """(entries in order, metadata) of a catalog's text."""
    entries, metadata = [], {}
    for part in re.split(r"\n\s*\n", text):
        e: dict = {"msgctxt": None, "msgid": "", "msgstr": "", "flags": [], "tcomment": "", "obsolete": False}
        now, some = "", False
        for line in part.splitlines():
            if line.startswith("#,"):
                e["flags"] += [x.strip() for x in line[2:].split(",") if x.strip()]
            elif line.startswith("#~") or not line.startswith("#"):
                e["obsolete"] |= line.startswith("#~")
                if m := _FIELD.match(line):
                    some, now = True, m[1] or now
                    e[now] = (e[now] or "") + re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[2])
            elif line.startswith("# "):
                e["tcomment"] = "\n".join(filter(None, [e["tcomment"], line[2:]]))
        if not some:
            continue
        if e["msgid"] == "" and e["msgctxt"] is None:
            metadata = dict(x.split(": ", 1) for x in e["msgstr"].split("\n") if ": " in x)
        else:
            entries.append(e)
    return entries, metadata


def load_or_create(path: str | None, language: str | None = None) -> tuple[list[dict], dict[str, str]]:
    """A catalog file's entries and metadata; none yet gives an empty one. A language that it names already stays."""
    if path is None:
        raise ValueError("a catalog needs a path")
    entries, metadata = loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else ([], {})
    metadata.setdefault("Content-Type", PLAIN)
    if language:
        metadata.setdefault("Language", language)
    return entries, metadata


def save(path: str | None, entries: list[dict], metadata: dict[str, str]) -> None:
    if path is None:
        raise ValueError("a catalog needs a path")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(dumps(entries, metadata), newline="\n", encoding="utf-8")


def rows(doc_id: int, entries: list[dict]) -> list[tuple]:
    """Rows of the catalog table."""
    return [(doc_id, k, e["msgctxt"], e["msgid"], e["msgstr"], "fuzzy" in e["flags"], e["obsolete"]) for k, e in enumerate(entries)]


def commented_rows(doc_id: int, entries: list[dict]) -> list[tuple]:
    """The same with comments; entries without a context, which no block can match, are left out."""
    return [(*row, e["tcomment"] or None) for row, e in zip(rows(doc_id, entries), entries) if e["msgctxt"] is not None]


def entries_of(found: list) -> list[dict]:
    """Entries of catalog rows, in their order."""
    return [{"msgctxt": r["msgctxt"], "msgid": r["msgid"], "msgstr": r["msgstr"], "flags": ["fuzzy"] if r["fuzzy"] else [], "tcomment": r["tcomment"] if "tcomment" in r else None, "obsolete": r["obsolete"]} for r in sorted(found, key=lambda r: r["ord"])]


def raw_catalogs(docs: DataFrame, root: str) -> DataFrame:
    """(doc_id, rel_path, raw): for every document the text of the catalog of its name below root, null if there is none.

    Two documents that differ in their suffix alone would share a catalog, which is refused.
    """
    spark, suffix = docs.sparkSession, r"(?<=[^/])\.[^./]*$"
    names = docs.select("doc_id", F.concat(F.regexp_replace("rel_path", suffix, ""), F.lit(".po")).alias("rel_path"))
    if twice := names.groupBy("rel_path").count().where("count > 1").first():
        raise ValueError(f"two sources would share the catalog {twice['rel_path']}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return names.withColumn("raw", F.lit(None).cast("string"))
    return names.join(documents.scan(spark, root, "*.po").select("rel_path", F.col("text").alias("raw")), "rel_path", "left").select("doc_id", "rel_path", "raw")


def read_catalogs(raw: DataFrame) -> DataFrame:
    """Catalog rows of raw_catalogs(); documents without a catalog have none."""

    def run(parts):
        for pdf in parts:
            found = [r for d, text in zip(pdf["doc_id"], pdf["raw"]) for r in commented_rows(d, loads(text)[0])]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in COMMENTED.split(", ")])

    return raw.where("raw IS NOT NULL").select("doc_id", "raw").mapInPandas(run, COMMENTED)


def write_catalogs(catalog: DataFrame, raw: DataFrame, root: str, language: str | None, created: str | None = None) -> None:
    """One file for each document of raw_catalogs(); what an old file's header says stays."""

    def run(entries: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        if not len(files):
            return pd.DataFrame([], columns=["rel_path", "text"])
        old = files["old"].iloc[0]
        head = loads(old)[1] if old else {}
        for name, value in (("Language", language), ("POT-Creation-Date", created)):
            if value:
                head.setdefault(name, value)
        rows_ = entries_of(entries.astype(object).where(entries.notna(), None).to_dict("records")) if len(entries) else []
        return pd.DataFrame([(files["path"].iloc[0], dumps(rows_, head))], columns=["rel_path", "text"])

    columns = [F.col(c).alias(c) for c in ("ord", "msgctxt", "msgid", "msgstr", "fuzzy", "obsolete", "tcomment")]
    files = raw.select(F.col("doc_id").alias("doc_id"), F.col("rel_path").alias("path"), F.col("raw").alias("old"))
    made = catalog.select("doc_id", *columns).groupBy("doc_id").cogroup(files.groupBy("doc_id")).applyInPandas(run, "rel_path string, text string")
    documents.write(made, root)
