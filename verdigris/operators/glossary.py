"""Glossaries that cascade down a directory tree.

A level is a row (dir, term, kind, scalar, by_locale): kind is keep (copy verbatim), text, locales or remove.
"""

from __future__ import annotations

import json

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = "dir string, term string, kind string, scalar string, by_locale map<string,string>"
REMOVE = "__remove__"


def level_rows(folder: str, raw: str | None) -> list[tuple]:
    """Rows of one glossary file; what is no JSON object gives none, and values of other types are ignored."""
    try:
        terms = json.loads(raw or "")
    except ValueError:
        return []
    if not isinstance(terms, dict):
        return []
    rows = []
    for term, value in terms.items():
        if value is None:
            rows.append((folder, term, "keep", None, None))
        elif isinstance(value, str):
            rows.append((folder, term, "remove" if value == REMOVE else "text", None if value == REMOVE else value, None))
        elif isinstance(value, dict):
            rows.append((folder, term, "locales", None, {k: v for k, v in value.items() if v is None or isinstance(v, str)}))
    return rows


def levels(spark: SparkSession, files: dict[str, str | None]) -> DataFrame:
    return spark.createDataFrame([r for folder, raw in files.items() for r in level_rows(folder, raw)], LEVELS)


def levels_of(files: DataFrame) -> DataFrame:
    """Levels of all glossary files (rel_path, text) of a tree; unreadable ones give none."""

    def run(parts):
        for pdf in parts:
            found = [r for path, raw in zip(pdf["rel_path"], pdf["text"]) for r in level_rows(path.rpartition("/")[0], raw)]
            yield pd.DataFrame(found, columns=["dir", "term", "kind", "scalar", "by_locale"])

    return files.select("rel_path", "text").mapInPandas(run, LEVELS)


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the root ('') first."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def chains(files: DataFrame) -> DataFrame:
    """(rel_path, dir, depth): every folder whose glossary a file inherits, outermost first."""
    folder = F.when(F.contains("rel_path", F.lit("/")), F.regexp_replace("rel_path", "/[^/]*$", "")).otherwise("")
    return files.select("rel_path", F.posexplode(ancestors(folder)).alias("depth", "dir"))


def cascaded(files: DataFrame, glossary: DataFrame, everywhere: DataFrame | None = None) -> DataFrame:
    """(rel_path, term, kind, scalar, by_locale): the terms in force for each file.

    The innermost level that is no per-locale map decides; per-locale maps further in merge over a per-locale one, the
    inner locale winning. remove takes the term out, and a later level may bring it back. everywhere has levels by
    depth in place of dir, which hold for all files.
    """
    columns = ["rel_path", "depth", "term", "kind", "scalar", "by_locale"]
    hits = chains(files).join(glossary, "dir").select(*columns)
    if everywhere is not None:
        # Named files and inline terms: as small as what a person writes.
        hits = hits.union(files.select("rel_path").join(everywhere).select(*columns))
    order = Window.partitionBy("rel_path", "term").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(F.when(F.col("kind") != "locales", F.col("depth"))).over(order)
    hits = hits.withColumn("base", F.coalesce(last, F.lit(-1)))
    tail = hits.where("depth >= base").groupBy("rel_path", "term").agg(
        F.max_by("kind", "depth").alias("top_kind"),
        F.max_by("scalar", "depth").alias("scalar"),
        F.expr("array_sort(collect_list(CASE WHEN kind = 'locales' THEN struct(depth, map_entries(by_locale) AS entries) END))").alias("maps"),
    )
    entries = F.expr("flatten(transform(maps, m -> m.entries))")
    # Later entries win: keep an entry if no later one has its key.
    newest = F.expr("filter(es, (e, i) -> NOT exists(slice(es, i + 2, size(es)), o -> o.key = e.key))")
    merged = tail.withColumn("es", entries).withColumn("by_locale", F.map_from_entries(newest))
    return merged.where("top_kind <> 'remove'").select("rel_path", "term", F.col("top_kind").alias("kind"), F.when(F.col("top_kind") == "text", F.col("scalar")).alias("scalar"), F.when(F.col("top_kind") == "locales", F.col("by_locale")).alias("by_locale"))


def resolved(terms: DataFrame, locale: Column) -> DataFrame:
    """Adds replacement: the target form for a locale, null for a term to copy verbatim."""
    value = F.when(F.col("kind") == "text", F.col("scalar")).when(F.col("kind") == "locales", F.try_element_at("by_locale", locale))
    return terms.withColumn("replacement", value)


def relevant(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Pairs of texts and the terms that occur in them, as plain substrings."""
    return texts.join(terms, F.contains(F.col(text), F.col("term")))


def term_pattern(term: Column) -> Column:
    """Regular expression of a term as a whole word; null if an end of it is no word character."""
    ends = term.rlike(r"^[\p{L}\p{N}_]") & term.rlike(r"[\p{L}\p{N}_]$")
    return F.when(ends, F.concat(F.lit(r"(?U)\b\Q"), term, F.lit(r"\E\b")))
