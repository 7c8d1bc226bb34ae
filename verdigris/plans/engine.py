"""Runs: documents and their catalog in, translated documents, catalog, coverage and receipt out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import batching, glossary, paths, placeholders, translate, usage
from ..operators import catalog as cat
from ..operators.pool import MAX_REFERENCES
from ..operators.prompts import Prompt
from ..operators.segment import blocks
from ..operators.worker import ANSWERS, Chat, Model, Rules, document_worker
from ..sources.storage import settled

VALIDATION, MODES, GLOSSARY_MODES = ("off", "conservative", "strict"), ("translate", "refine"), ("placeholder", "instruction")
POOL = "doc_id long, ord int, lang string, src string, tgt string"


@dataclass(frozen=True)
class Config:
    """What a run does. batch and single, or chat, are the calls to a model; they run on executors.

    batch takes {key: text} as JSON, single a text. chat takes whole messages and options, with prompts, glossary and
    reference pairs in them, and may return usage. batch_size 0 asks for one entry at a time. progress is called on the
    driver with (kind, fields); what it raises is ignored.
    """

    batch: translate.BatchCall = translate.echo
    single: translate.SingleCall | None = translate.echo_one
    chat: Chat | None = None
    model: str = ""
    target_lang: str = "en"
    mode: str = "translate"
    validation: str = "off"
    glossary_mode: str = "placeholder"
    glossary: dict[str, str | None] | None = None
    placeholders: placeholders.Registry | None = None
    post_process: Callable[[str], str] | None = None
    extra_instructions: str = ""
    prompt_cache: bool = False
    json_mode: bool = False
    context_id: Callable[[dict], str] | None = None
    progress: Callable[[str, dict], None] | None = None
    batch_size: int = batching.BATCH_SIZE
    batch_chars: int = batching.BATCH_CHARS
    reference_pairs: int = MAX_REFERENCES

    def __post_init__(self):
        for value, allowed in ((self.validation, VALIDATION), (self.mode, MODES), (self.glossary_mode, GLOSSARY_MODES)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
        if self.batch_size < 0 or self.batch_chars < 1 or self.reference_pairs < 0:
            raise ValueError("batch_size and reference_pairs can't be negative, batch_chars must be positive")

    def refining(self, language: str) -> Config:
        """The sibling that polishes this run's output in its own language, without its glossary and hooks."""
        return replace(self, mode="refine", target_lang=language, glossary=None, progress=None)

    def rules(self) -> Rules:
        prompt = Prompt(self.target_lang, self.mode, self.extra_instructions, self.model, self.prompt_cache, self.json_mode)
        return Rules(Model(self.batch, self.single, self.chat), prompt, self.validation, self.glossary_mode, self.placeholders, self.post_process, self.batch_size, self.batch_chars, self.reference_pairs)

    def tell(self, kind: str, **fields: object) -> None:
        if self.progress is not None:
            try:
                self.progress(kind, fields)
            except Exception:  # a listener never ends a run
                pass


@dataclass(frozen=True)
class Result:
    documents: DataFrame
    catalog: DataFrame
    answers: DataFrame
    coverage: DataFrame

    def statistics(self) -> dict[str, int]:
        """Entries and calls of the run, over all its documents."""
        row = self.answers.agg(
            F.count("*").alias("entries"),
            F.count_if(~F.col("failed")).alias("processed"),
            F.count_if("failed").alias("failed"),
            F.count_if(F.col("reason").isNotNull()).alias("validation_failed"),
            F.count_if("echo").alias("echoes"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("calls", "api_calls"), ("per_entry", "per_entry_calls"), ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"))],
        ).first()
        return row.asDict()

    def receipt(self, model: str, prices: dict | None = None, **about: object) -> dict:
        return usage.receipt(model, self.statistics(), prices, **about)


def by_document(answers: DataFrame) -> DataFrame:
    """(doc_id, failed, validation_failed, processed, api_calls, input_tokens, output_tokens, status) of each document."""
    sums = [F.sum(c).cast("long").alias(n) for c, n in (("calls", "api_calls"), ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"))]
    out = answers.groupBy("doc_id").agg(F.count_if("failed").alias("failed"), F.count_if(F.col("reason").isNotNull()).alias("validation_failed"), F.count_if(~F.col("failed")).alias("processed"), *sums)
    return usage.directory_status(out)


def _pool(now: DataFrame, config: Config, lang: str, glossaries: DataFrame | None, more: DataFrame | None) -> DataFrame:
    """Rows that a document's worker starts with: reference pairs, pairs carried over, the document's own glossary."""
    rows = cat.pool_seed(now).select("doc_id", "ord", F.lit(lang).alias("lang"), "src", "tgt")
    if config.reference_pairs == 0:
        rows = rows.where(F.lit(False))
    if more is not None:
        rows = rows.union(more.select("doc_id", F.lit(-1).alias("ord"), F.lit(lang), "src", "tgt"))
    if glossaries is not None:
        rows = rows.union(glossaries.select("doc_id", F.lit(-2).alias("ord"), F.lit(lang), F.to_json("glossary", {"ignoreNullFields": "false"}).alias("src"), F.lit(None).cast("string")))
    return rows


def _asked(todo: DataFrame, pool: DataFrame, rules: Rules, langs: list[str] | None, terms: dict | None) -> DataFrame:
    work = document_worker(rules, langs, terms)
    # Both sides come from one table: a column that they share by origin would reach only one side.
    todo = todo.select(F.col("doc_id").alias("doc_id"), F.col("ord").alias("at"), "msgctxt", F.col("msgid").alias("msgid"), "langs")
    return settled(todo.groupBy("doc_id").cogroup(pool.groupBy("doc_id")).applyInPandas(work, ANSWERS))


def run(docs: DataFrame, catalog: DataFrame, config: Config, glossaries: DataFrame | None = None, carryover: DataFrame | None = None) -> Result:
    """One incremental run over (doc_id, text) documents: only new and changed blocks reach the model.

    Answers that lose placeholders, move them, or fail a check leave the entry untranslated and fuzzy, with the reason
    as its comment. glossaries (doc_id, glossary map) take the place of config.glossary for their documents; carryover
    (doc_id, src, tgt) are further reference pairs. Answers are written before anything is made of them: a failure
    later in the run asks nothing again, and an exception here carries what was billed as partial_receipt.

    Null and empty texts have no blocks and come back as they are; an empty table gives empty results; rows that repeat
    a doc_id are blocks of one document and should not be given.
    """
    config.tell("run_start", mode=config.mode, target_lang=config.target_lang)
    found = settled(blocks(docs, config.context_id))
    now = settled(cat.reordered(cat.sync(found, catalog)))
    todo = cat.pending(now).select("doc_id", "ord", "msgctxt", "msgid", F.array(F.lit(config.target_lang)).alias("langs"))
    pool = _pool(now, config, config.target_lang, glossaries, carryover)
    answers = _asked(todo, pool, config.rules(), None, {config.target_lang: config.glossary or {}})
    try:
        after = cat.committed(now, answers.select("doc_id", "msgctxt", "answer", "failed", "reason"))
        out = Result(cat.rebuilt(found, after, docs), after, answers, cat.coverage(found, after, "doc_id", "type"))
        config.tell("run_end")
        return out
    except Exception as e:
        e.partial_receipt = Result(docs, now, answers, docs).receipt(config.model)
        raise


def run_inplace(docs: DataFrame, catalog: DataFrame, config: Config, glossaries: DataFrame | None = None) -> Result:
    """A run whose output replaces its documents: the catalog is drawn anew from the output, each block its own text.

    Refused entries keep their flag and comment, found by text and occurrence.
    """
    if config.mode == "refine":
        raise ValueError("refining never overwrites its source")
    made = run(docs, catalog, config, glossaries)
    output = settled(made.documents)
    fresh = cat.redrawn(blocks(output, config.context_id), made.catalog)
    return replace(made, documents=output, catalog=fresh)


def refine_first(docs: DataFrame, refined_catalog: DataFrame, catalog: DataFrame, config: Config, language: str, glossaries: DataFrame | None = None) -> tuple[Result, Result]:
    """Polishes documents in their own language, then translates what came of it; each pass has its own catalog.

    What the second catalog held before serves as reference pairs, since polished texts seldom match it.
    """
    if not language:
        raise ValueError("refining first needs the documents' language")
    if config.mode != "translate":
        raise ValueError("refining first is part of a translation")
    polished = run(docs, refined_catalog, config.refining(language))
    before = cat.pool_seed(catalog).select("doc_id", "src", "tgt")
    return polished, run(settled(polished.documents), catalog, config, glossaries, before)


def run_languages(docs: DataFrame, catalog: DataFrame, config: Config, languages: list[str], glossaries: dict[str, dict[str, str | None]] | None = None) -> Result:
    """Several target languages, one call for a group: catalog, answers and documents have a lang column.

    A block goes to the model when any language lacks it, in source order, and only the languages that lack it take
    the answer. A language that the answer leaves out is asked for by itself. Each language has its own reference
    pairs, glossary and checks. Glossary terms are told to the model, not coded: a code could hold one form only.
    """
    wanted = list(dict.fromkeys(languages))
    if not wanted or any(not isinstance(x, str) or not x for x in wanted):
        raise ValueError("languages must be non-empty names")
    if config.mode == "refine":
        raise ValueError("refining is for one language")
    if config.glossary_mode == "placeholder" and (glossaries or config.glossary):
        raise ValueError("several languages need glossary_mode instruction")
    found = settled(blocks(docs, config.context_id))
    by_lang = pools = None
    for lang in wanted:
        one = cat.reordered(cat.sync(found, catalog.where(F.col("lang") == lang).drop("lang"))).withColumn("lang", F.lit(lang))
        by_lang = one if by_lang is None else by_lang.union(one)
    by_lang = settled(by_lang)
    for lang in wanted:
        part = _pool(by_lang.where(F.col("lang") == lang), config, lang, None, None)
        pools = part if pools is None else pools.union(part)
    lacking = cat.pending(by_lang).groupBy("doc_id", "msgctxt").agg(F.collect_set("lang").alias("langs"))
    todo = found.join(lacking, ["doc_id", "msgctxt"]).select("doc_id", F.col("seq").alias("ord"), "msgctxt", F.col("text").alias("msgid"), "langs")
    terms = {lang: (glossaries or {}).get(lang, config.glossary or {}) for lang in wanted}
    answers = _asked(todo, pools, config.rules(), wanted, terms)
    after = documents = coverage = None
    for lang in wanted:
        mine = cat.committed(by_lang.where(F.col("lang") == lang).drop("lang"), answers.where(F.col("lang") == lang).select("doc_id", "msgctxt", "answer", "failed", "reason"))
        parts = (mine, cat.rebuilt(found, mine, docs), cat.coverage(found, mine, "doc_id", "type"))
        parts = [p.withColumn("lang", F.lit(lang)) for p in parts]
        after, documents, coverage = parts if after is None else (a.union(b) for a, b in zip((after, documents, coverage), parts))
    return Result(documents, after, answers, coverage)


def run_multi(docs: DataFrame, catalog: DataFrame, batch: translate.BatchCall, languages: list[str], size: int = batching.BATCH_SIZE, chars: int = batching.BATCH_CHARS) -> DataFrame:
    """(lang, catalog columns) after run_languages() with a plain batch call and nothing else."""
    out = run_languages(docs, catalog, Config(batch=batch, single=None, batch_size=size, batch_chars=chars), languages)
    return out.catalog.select("lang", *cat.COLUMNS)


def directory_glossaries(files: DataFrame, levels: DataFrame, locale: str, above: tuple | list = (), below: tuple | list = ()) -> DataFrame:
    """(rel_path, glossary): the terms in force for each file, as a map for one locale.

    The folders from the root of files down to the file's own come after those of below, which lie outside of it, and
    before those of above: the folder that a run starts in, a named file, inline terms.
    """
    spark = files.sparkSession
    levels_ = [(k - len(below), o) for k, o in enumerate(below)] + [((1 << 20) + k, o) for k, o in enumerate(above)]
    rows = [(depth, *x[1:]) for depth, o in levels_ for x in glossary.level_rows("", json.dumps(o))]
    extra = spark.createDataFrame(rows, glossary.LEVELS.replace("dir string", "depth int")) if rows else None
    terms = glossary.resolved(glossary.cascaded(files, levels, extra), F.lit(locale))
    return terms.groupBy("rel_path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "replacement")))).alias("glossary"))


def glossary_of(levels: list[str], named: dict | None, locale: str) -> dict[str, str | None]:
    """The same for one file, on the driver: glossary texts from the outermost folder inwards, then named terms."""
    merged: dict[str, object] = {}
    for raw in [*levels, json.dumps(named or {})]:
        for _, term, kind, scalar, forms in glossary.level_rows("", raw):
            held = merged.get(term)
            if kind == "remove":
                merged.pop(term, None)
            elif kind == "locales":
                merged[term] = {**held, **forms} if isinstance(held, dict) else forms
            else:
                merged[term] = scalar
    return {t: v.get(locale) if isinstance(v, dict) else v for t, v in merged.items()}


#: Segments of paths that one worker takes: names are short, and each is asked for once.
PATH_GROUP = 400


def translated_paths(files: DataFrame, known: DataFrame, config: Config, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Result]:
    """(map of src to tgt, catalog of segments, what was asked) for files (rel_path) and known (segment, msgstr, fuzzy).

    Segments that the catalog lacks go to the model in groups of about PATH_GROUP; no check is made of them. Segments
    that no file has any more stay in the catalog.
    """
    here = paths.segments(files)
    all_ = settled(paths.synced(here, known))
    lacking = all_.where("msgstr = '' OR fuzzy").join(here.select("segment"), "segment", "left_semi")
    groups = max(1, -(-lacking.count() // PATH_GROUP))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("msgid"))
    todo = lacking.select(F.pmod(F.xxhash64("segment"), F.lit(groups)).alias("doc_id"), F.concat(F.lit("path::segment::"), "segment").alias("msgctxt"), F.col("segment").alias("msgid"), F.array(F.lit(config.target_lang)).alias("langs")).withColumn("ord", place)
    done = all_.where("msgstr <> '' AND NOT fuzzy").select(F.pmod(F.xxhash64("segment"), F.lit(groups)).alias("doc_id"), F.lit(0).alias("ord"), F.lit(config.target_lang).alias("lang"), F.col("segment").alias("src"), F.col("msgstr").alias("tgt"))
    rules = replace(config, validation="off", placeholders=None).rules()
    answers = _asked(todo, done, rules, None, {config.target_lang: config.glossary or {}})
    given = answers.where("NOT failed AND answer IS NOT NULL").select(F.col("source").alias("segment"), "answer")
    after = settled(all_.join(given, "segment", "left").select("segment", F.coalesce("answer", "msgstr").alias("msgstr"), (F.col("fuzzy") & F.col("answer").isNull()).alias("fuzzy")))
    slugs = after.select("segment", paths.segment_name(F.col("msgstr"), F.col("segment")).alias("slug"))
    return paths.mapped(files, slugs, previous), after, Result(files, after, answers, after)


def named_glossary(file: dict | None, inline: dict | None, locale: str) -> dict[str, str | None]:
    """Terms of a named file and inline ones over them, for one locale; remove marks in the file do nothing."""
    out: dict[str, str | None] = {}
    for source, is_file in ((file, True), (inline, False)):
        for term, value in (source or {}).items():
            if value == glossary.REMOVE:
                if not is_file:
                    out.pop(term, None)
            elif value is None or isinstance(value, str):
                out[term] = value
            elif isinstance(value, dict):
                out[term] = value.get(locale)
    return out


def report(title: str, coverage: DataFrame, created: str | None = None) -> str:
    """Coverage of one run as text; types stand in the order of their first block where coverage has first, else by name."""
    order = F.min("first") if "first" in coverage.columns else F.min("type")
    rows = coverage.groupBy("type").agg(*[F.sum(c).alias(c) for c in ("total", "translatable", "translated", "fuzzy")], order.alias("o")).orderBy("o").collect()
    total = [sum(r[c] for r in rows) for c in ("total", "translatable", "translated", "fuzzy")]
    share = 100.0 * total[2] / total[1] if total[1] else 0.0
    out = [f"Coverage of {title}", f"Created {created or 'Unknown'}", f"Blocks {total[0]}, translatable {total[1]}, translated {total[2]} ({share:.1f} %), fuzzy {total[3]}, untranslated {total[1] - total[2] - total[3]}"]
    out += [f"  {r['type'].title()}: " + (f"{r['translated']}/{r['translatable']} ({100.0 * r['translated'] / r['translatable']:.1f} %), fuzzy {r['fuzzy']}" if r["translatable"] else f"{r['total']} (non-translatable)") for r in rows]
    return "\n".join(out)
