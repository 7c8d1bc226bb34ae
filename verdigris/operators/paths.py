"""Translated output paths: segments, slugs, siblings, the published map and stale outputs."""

from __future__ import annotations

import json
import unicodedata
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_slug, safe_segment
from ..sources.storage import settled


def nfc(text: Column) -> Column:
    """Unicode composition, which has no SQL function.

    Texts of characters below U+0300 alone are composed as they are and stay in the JVM; the others go to Python, which
    takes a few rows of whole texts at a time here, not an Arrow batch of thousands.
    """
    return F.coalesce(F.udf(_nfc, "string", useArrow=False)(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def _nfc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFC", text)


def segments(files: DataFrame) -> DataFrame:
    """(segment, first_file, first_pos): distinct translatable segments in order of appearance; no suffix of the file."""
    stem = F.regexp_replace("rel_path", r"\.[^./]*$", "")
    parts = files.select("rel_path", F.posexplode(F.split(stem, "/")).alias("pos", "segment"))
    good = parts.where((F.col("segment") != "") & ~F.startswith("segment", F.lit(".")))
    first = F.min(F.struct("rel_path", "pos")).alias("f")
    return good.groupBy("segment").agg(first).select("segment", F.col("f.rel_path").alias("first_file"), F.col("f.pos").alias("first_pos"))


def segment_name(translated: Column, raw: Column) -> Column:
    """File name of a translated segment: its slug, else that of the segment itself, else a hashed one."""
    made, own = path_slug(nfc(F.coalesce(translated, F.lit("")))), path_slug(nfc(raw))
    return F.coalesce(F.nullif(made, F.lit("")), F.nullif(own, F.lit("")), safe_segment(raw))


def _siblings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that already have a name keep it and hold it against the others."""
    pdf = pdf.sort_values(["first_file", "segment"])
    used, following = {n.casefold() for n in pdf["name"] if n is not None}, {}
    names = []
    for base, name in zip(pdf["slug"], pdf["name"]):
        if name is None:
            key, n = base.casefold(), following.get(base.casefold(), 1)
            name = base if n == 1 else f"{base}-{n}"
            # The next number to try is remembered, so that equal slugs don't count from 2 each.
            while name.casefold() in used:
                n += 1
                name = f"{base}-{n}"
            following[key] = n + 1
            used.add(name.casefold())
        names.append(name)
    return pdf.assign(name=names)[["parent", "segment", "slug", "name"]]


def disambiguated(entries: DataFrame) -> DataFrame:
    """(parent, segment, slug, name): equal slugs under one parent get -2, -3 and so on, names in use being skipped.

    Slugs are equal whatever their case. The first by first_file (segment, where there is none) gets the slug itself; a
    name that a row brings along stays. A slug that no sibling shares, and that can't be another's numbered name, is
    its own name: only the others of a parent are taken together, since each name depends on those before it.
    """
    for column, default in (("first_file", F.col("segment")), ("name", F.lit(None).cast("string"))):
        if column not in entries.columns:
            entries = entries.withColumn(column, default)
    base = F.lower(F.regexp_replace(F.col("slug"), r"(-\d+)+$", ""))
    alone = (F.count("*").over(Window.partitionBy("parent", base)) == 1) & F.col("name").isNull()
    marked = entries.withColumn("alone", alone)
    single = marked.where("alone").select("parent", "segment", "slug", F.col("slug").alias("name"))
    rest = marked.where("NOT alone").groupBy("parent", base.alias("base")).applyInPandas(lambda k, p: _siblings(p), "parent string, segment string, slug string, name string")
    return single.union(rest)


def mapped(files: DataFrame, slugs: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(src, tgt): the translated path of every file (rel_path), level by level below translated parents.

    slugs has (segment, slug). Files of previous (src, tgt) that aren't in files keep their names: a segment whose slug
    is still what it was holds its place among siblings. Suffixes and segments that aren't translated stay.
    """
    now = files.select("rel_path", F.lit(None).cast("string").alias("kept"))
    if previous is not None:
        old = previous.join(files.select(F.col("rel_path").alias("src")), "src", "left_anti").where(F.size(F.split("src", "/")) == F.size(F.split("tgt", "/")))
        now = now.union(old.where(F.regexp_extract("src", r"\.[^./]*$", 0) == F.regexp_extract("tgt", r"\.[^./]*$", 0)).select("src", "tgt"))
    stem = r"(?<=[^/])\.[^./]*$"
    walk = now.select("rel_path", F.col("kept").isNotNull().alias("old"), F.split(F.regexp_replace("rel_path", stem, ""), "/").alias("parts"), F.split(F.regexp_replace("kept", stem, ""), "/").alias("kept"), F.regexp_extract("rel_path", stem, 0).alias("suffix"), F.lit("").alias("parent"))
    walk = settled(walk)
    for level in range(walk.agg(F.max(F.size("parts"))).first()[0] or 0):
        here = walk.where(F.size("parts") > level).withColumn("segment", F.col("parts")[level]).join(slugs, "segment", "left")
        here = here.withColumn("slug", F.coalesce("slug", segment_name(F.lit(None).cast("string"), F.col("segment"))))
        open_ = (F.col("segment") != "") & ~F.startswith("segment", F.lit("."))
        # An old file names its segment only if the slug is still the same.
        holds = F.when(F.col("old") & (F.col("slug") == F.col("kept")[level]), F.col("slug"))
        siblings = here.where(open_).groupBy("parent", "segment", "slug").agg(F.min("rel_path").alias("first_file"), F.max(holds).alias("name"), F.bool_and("old").alias("gone"))
        named = disambiguated(siblings.where("NOT gone OR name IS NOT NULL").drop("gone")).select("parent", "segment", "name")
        here = here.join(named, ["parent", "segment"], "left").withColumn("name", F.when(F.col("old"), F.col("kept")[level]).otherwise(F.coalesce("name", "segment")))
        below = here.withColumn("parent", F.concat_ws("/", F.nullif("parent", F.lit("")), "name")).select(*walk.columns)
        walk = settled(below.union(walk.where(F.size("parts") <= level)))
    return walk.where("NOT old").select(F.col("rel_path").alias("src"), F.concat("parent", "suffix").alias("tgt"))


def synced(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """(segment, msgstr, fuzzy): the catalog of path segments with the new ones added; none is ever removed."""
    return segments.select("segment").join(catalog, "segment", "full_outer").select("segment", F.coalesce("msgstr", F.lit("")).alias("msgstr"), F.coalesce("fuzzy", F.lit(False)).alias("fuzzy"))


def mirrored(sources: DataFrame, outputs: DataFrame, previous: DataFrame) -> DataFrame:
    """previous (src, tgt), and a row for each source that has an output of its own name but none in previous."""
    legacy = sources.select(F.col("rel_path").alias("src")).join(outputs.select(F.col("rel_path").alias("src")), "src", "left_semi").join(previous.select("src"), "src", "left_anti")
    return previous.select("src", "tgt").union(legacy.select("src", F.col("src").alias("tgt")))


def read_map(raw: str | None) -> dict[str, str]:
    """A published map; what is no JSON object gives an empty one, pairs of other things than texts are left out."""
    try:
        found = json.loads(raw or "")
    except ValueError:
        return {}
    return {k: v for k, v in found.items() if isinstance(v, str)} if isinstance(found, dict) else {}


def write_map(rows: dict[str, str]) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def removed(root: str, targets: list[str]) -> list[str]:
    """Deletes files below root, never one that a path leads to outside of it; gives those that were there."""
    base, gone = Path(root).resolve(), []
    for t in targets:
        file = (base / t).resolve()
        if base in file.parents and file.is_file():
            file.unlink()
            gone.append(t)
    return gone


def published(prior: DataFrame, run: DataFrame) -> DataFrame:
    """(src, tgt): prior rows whose source is still there, overridden by this run's successes.

    run has (src, tgt, ok); every source that exists is in it.
    """
    both = prior.select("src", F.col("tgt").alias("old")).join(run, "src", "full_outer")
    return both.where("ok IS NOT NULL").select("src", F.when(F.col("ok"), F.col("tgt")).otherwise(F.col("old")).alias("tgt")).where("tgt IS NOT NULL")


def stale(prior: DataFrame, run: DataFrame) -> DataFrame:
    """(tgt): prior outputs that may be deleted: their source is gone or was written elsewhere, and no one claims them."""
    now = published(prior, run).select("tgt")
    old = prior.join(run.select("src", "ok", F.col("tgt").alias("new")), "src", "left")
    return old.where((F.col("ok").isNull()) | (F.col("ok") & (F.col("tgt") != F.col("new")))).select("tgt").join(now, "tgt", "left_anti").distinct()
