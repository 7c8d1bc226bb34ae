"""Command line: translate, translate-dir, translate-multi, refine, refine-dir, estimate and report.

A model is reached by --translator or --chat, each as module:function, or by --model through litellm where that is
installed. Without any of them texts are echoed, offline. Catalogs are gettext files beside the outputs.
"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import sys
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import language_names
from .operators import batching, glossary, paths, translate, usage
from .operators import catalog as cat
from .operators.segment import blocks
from .plans import engine
from .sources import documents, po, provider
from .sources.storage import settled

PATHS_PO, PATH_MAP, GLOSSARY = "_paths.po", "path_map.json", "glossary.json"


def _shared(s: argparse.ArgumentParser) -> None:
    s.add_argument("--model", default="")
    s.add_argument("--translator", help="module:function that takes and returns JSON of a batch")
    s.add_argument("--chat", help="module:function that takes messages and options")
    s.add_argument("--batch-size", default=batching.BATCH_SIZE, type=int, help="entries in a call; 0 asks for one at a time")
    s.add_argument("--batch-max-chars", default=batching.BATCH_CHARS, type=int)
    s.add_argument("--batch-concurrency", default=1, type=int, help="accepted; executors run documents side by side")
    s.add_argument("--max-reference-pairs", default=engine.MAX_REFERENCES, type=int)


def _calling(s: argparse.ArgumentParser, target: bool = True) -> None:
    _shared(s)
    if target:
        s.add_argument("--target", required=True)
    s.add_argument("--validation", default="off", choices=engine.VALIDATION)
    s.add_argument("--glossary")
    s.add_argument("--glossary-mode", default="placeholder", choices=engine.GLOSSARY_MODES)
    s.add_argument("--extra-instructions", default="")
    s.add_argument("--prompt-cache", action="store_true")
    s.add_argument("--json-mode", action="store_true")
    s.add_argument("--inplace", action="store_true")
    s.add_argument("--json-receipt")
    s.add_argument("--no-progress", action="store_true")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verdigris")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name, output in (("translate", "target_file"), ("refine", "target_file")):
        s = sub.add_parser(name)
        s.add_argument("source")
        s.add_argument(output)
        s.add_argument("--po")
        _calling(s)
    for name in ("translate-dir", "refine-dir"):
        s = sub.add_parser(name)
        s.add_argument("source_dir")
        s.add_argument("target_dir")
        s.add_argument("--po-dir")
        s.add_argument("--glob", default="*.md")
        s.add_argument("--max-workers", type=int, help="accepted; Spark's executors are the workers")
        _calling(s)
    one, many = sub.choices["translate"], sub.choices["translate-dir"]
    for s, refined, catalog in ((one, "--refined-path", "--refined-po-path"), (many, "--refined-dir", "--refined-po-dir")):
        s.add_argument("--refine-first", action="store_true")
        s.add_argument(refined, dest="refined")
        s.add_argument(catalog, dest="refined_po")
        s.add_argument("--refine-lang")
    many.add_argument("--translate-paths", action="store_true")
    s = sub.add_parser("translate-multi")
    s.add_argument("source")
    s.add_argument("--langs", required=True)
    s.add_argument("--target-template", required=True)
    s.add_argument("--po-template")
    _calling(s, target=False)
    s = sub.add_parser("estimate")
    s.add_argument("source")
    s.add_argument("--po")
    s.add_argument("--target", default="en")
    _shared(s)
    s = sub.add_parser("report")
    s.add_argument("source")
    s.add_argument("po")
    return p


def _named(name: str | None):
    if not name:
        return None
    module, _, attr = name.partition(":")
    return getattr(importlib.import_module(module), attr)


def _terms(args: argparse.Namespace) -> dict | None:
    """Terms of a named file; one that can't be read is an error, unlike those found in folders."""
    if not args.glossary:
        return None
    found = json.loads(Path(args.glossary).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{args.glossary} holds no object")
    return found


def _config(args: argparse.Namespace, mode: str = "translate") -> engine.Config:
    chat, batch = _named(args.chat), _named(args.translator)
    if args.model and not chat and not batch:
        if importlib.util.find_spec("litellm") is None:
            raise ValueError(f"no way to reach {args.model}: name a --translator or --chat, or install litellm")
        chat = provider.completion
    plain = {"batch": batch or translate.echo, "single": None if batch else translate.echo_one}
    terms = engine.named_glossary(_terms(args), None, args.target)
    return engine.Config(
        **plain,
        chat=chat,
        model=args.model,
        target_lang=args.target,
        mode=mode,
        validation=args.validation,
        glossary_mode=args.glossary_mode,
        glossary=terms or None,
        extra_instructions=args.extra_instructions,
        prompt_cache=args.prompt_cache,
        json_mode=args.json_mode,
        progress=None if args.no_progress or args.verbose or not sys.stderr.isatty() else lambda kind, fields: print(kind, *fields.values(), file=sys.stderr),
        batch_size=args.batch_size,
        batch_chars=args.batch_max_chars,
        reference_pairs=args.max_reference_pairs,
    )


def _apart(**named: str | Path | None) -> None:
    """No two of these may be one path, and none may lie where another is a folder's own file."""
    seen: dict[Path, str] = {}
    for name, path in named.items():
        if path is None:
            continue
        full = Path(path).resolve()
        if full in seen:
            raise ValueError(f"{name} and {seen[full]} are one path: {path}")
        seen[full] = name


def _show(found: dict) -> None:
    print(json.dumps(found, indent=2, ensure_ascii=False, default=str))


def _billed(args: argparse.Namespace, receipt: dict) -> None:
    print(usage.rendered(receipt), file=sys.stderr)
    if args.json_receipt:
        path = Path(args.json_receipt)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(receipt, indent=2, ensure_ascii=False), encoding="utf-8")


def _one(spark: SparkSession, path: str) -> DataFrame:
    if not Path(path).is_file():
        raise ValueError(f"{path} is no file")
    text = Path(path).read_text(encoding="utf-8").replace("\r\n", "\n").replace("\r", "\n")
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def _catalog(spark: SparkSession, path: str | Path, language: str | None) -> tuple[DataFrame, dict[str, str]]:
    entries, head = po.load_or_create(str(path), language)
    head.setdefault("POT-Creation-Date", _now())
    return spark.createDataFrame(po.commented_rows(0, entries), po.COMMENTED), head


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M+0000")


def _stored(result: engine.Result, file: str | Path, catalog: str | Path, head: dict[str, str]) -> None:
    """The catalog first: what was paid for is safe whatever becomes of the document."""
    po.save(str(catalog), po.entries_of(result.catalog.collect()), head)
    Path(file).parent.mkdir(parents=True, exist_ok=True)
    Path(file).write_text(result.documents.first()["text"] or "", newline="\n", encoding="utf-8")


def _covered(result: engine.Result) -> dict:
    row = result.coverage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "translatable", "translated", "fuzzy")]).first()
    return row.asDict()


def _file(spark: SparkSession, args: argparse.Namespace) -> int:
    began, refining = time.time(), args.command == "refine"
    config = _config(args, "refine" if refining else "translate")
    first = not refining and args.refine_first
    catalog = Path(args.po) if args.po else Path(args.target_file).with_suffix(".po")
    refined_po = Path(args.refined_po) if first and args.refined_po else Path(args.refined).with_suffix(".po") if first else None
    source = None if args.inplace else args.source
    _apart(source=source, target=args.target_file, catalog=catalog, refined=args.refined if first else None, refined_catalog=refined_po)
    docs = _one(spark, args.source)
    old, head = _catalog(spark, catalog, args.target)
    outside, here = _levels_above(Path(args.source).resolve())
    terms = {} if refining else engine.glossary_of([json.dumps(x) for x in [*outside, *here]], _terms(args), args.target)
    config = engine.replace(config, glossary=terms or None)
    results = []
    if first:
        polished_old, polished_head = _catalog(spark, refined_po, args.refine_lang)
        polished, made = engine.refine_first(docs, polished_old, old, config, args.refine_lang)
        _stored(polished, args.refined, refined_po, polished_head)
        results.append(polished)
    else:
        made = (engine.run_inplace if args.inplace else engine.run)(docs, old, config)
    results.append(made)
    _stored(made, args.target_file, catalog, head)
    counts = _summed([r.statistics() for r in results])
    _show({"source_path": args.source, "target_path": args.target_file, "po_path": str(catalog), "translation_stats": counts, "coverage": _covered(made)})
    _billed(args, usage.receipt(args.model, counts, None, target_lang=args.target, source_path=args.source, target_path=args.target_file, catalog_path=str(catalog), duration_seconds=time.time() - began))
    return int(counts["failed"] > 0 or counts["validation_failed"] > 0)


def _summed(each: list[dict]) -> dict:
    return {k: sum(x[k] for x in each) for k in each[0]}


def _levels_above(source: Path) -> tuple[list[dict], list[dict]]:
    """Glossaries of the folders above a file or folder, outermost first; and that of the current folder, if it is none of them."""

    def read(folder: Path) -> list[dict]:
        try:
            found = json.loads((folder / GLOSSARY).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return []
        return [found] if isinstance(found, dict) else []

    chain, here = list(reversed(source.parents)), Path.cwd().resolve()
    return [x for folder in chain for x in read(folder)], [] if here in [*chain, source] else read(here)


def _directory(spark: SparkSession, args: argparse.Namespace) -> int:
    began, refining = time.time(), args.command == "refine-dir"
    if not Path(args.source_dir).is_dir():
        raise ValueError(f"{args.source_dir} is no folder")
    config = _config(args, "refine" if refining else "translate")
    first, naming = not refining and args.refine_first, not refining and args.translate_paths
    _apart(source=None if args.inplace else args.source_dir, target=args.target_dir, refined=args.refined if first else None)
    _apart(catalogs=args.po_dir or args.target_dir, refined_catalogs=(args.refined_po or args.refined) if first else None)
    if naming and args.inplace:
        raise ValueError("translated paths and inplace exclude each other")
    docs = settled(documents.scan(spark, args.source_dir, args.glob))
    po_dir = args.po_dir or args.target_dir
    if naming and not docs.where(F.regexp_replace("rel_path", r"\.[^./]*$", "") == PATHS_PO[:-3]).isEmpty():
        raise ValueError(f"a source's catalog would be {PATHS_PO}, which holds the paths")
    raw = po.raw_catalogs(docs, po_dir)
    old = po.read_catalogs(raw)
    glossaries = None
    if not refining:
        levels = glossary.levels_of(documents.scan(spark, args.source_dir, GLOSSARY))
        outside, here = _levels_above(Path(args.source_dir).resolve())
        found = engine.directory_glossaries(docs, levels, args.target, above=[*here, _terms(args) or {}], below=outside)
        glossaries = docs.select("doc_id", "rel_path").join(found, "rel_path").select("doc_id", "glossary")
    results, segments = [], None
    if first:
        polished_raw = po.raw_catalogs(docs, args.refined_po or args.refined)
        polished, made = engine.refine_first(docs, po.read_catalogs(polished_raw), old, config, args.refine_lang, glossaries)
        po.write_catalogs(polished.catalog, polished_raw, args.refined_po or args.refined, args.refine_lang)
        documents.write(docs.select("doc_id", "rel_path").join(polished.documents, "doc_id"), args.refined)
        results.append(polished)
    else:
        made = (engine.run_inplace if args.inplace else engine.run)(docs, old, config, glossaries)
    results.append(made)
    # Catalogs first: what was paid for is safe whatever becomes of the documents.
    po.write_catalogs(made.catalog, raw, po_dir, args.target)
    each = settled(engine.by_document(made.answers))
    out = docs.select("doc_id", "rel_path").join(made.documents, "doc_id")
    if naming:
        segments = _named_outputs(spark, args, docs, out, each, config, po_dir)
        results.append(segments)
    else:
        documents.write(out, args.target_dir)
    counts = _summed([r.statistics() for r in results])
    status = {r["status"]: r["n"] for r in each.groupBy("status").agg(F.count("*").alias("n")).collect()}
    total = docs.count()
    failed = status.get("failed", 0)
    done = status.get("processed", 0)
    _show({"source_dir": args.source_dir, "target_dir": args.target_dir, "po_dir": po_dir, "files_processed": done, "files_failed": failed, "files_skipped": total - done - failed})
    _billed(args, usage.receipt(args.model, counts, None, target_lang=args.target, source_path=args.source_dir, target_path=args.target_dir, catalog_path=po_dir, duration_seconds=time.time() - began))
    return int(failed > 0)


def _named_outputs(spark: SparkSession, args: argparse.Namespace, docs: DataFrame, out: DataFrame, each: DataFrame, config: engine.Config, po_dir: str) -> engine.Result:
    """Writes documents under translated paths, the catalog of path segments and the published map; removes stale files."""
    map_file, po_file = Path(po_dir) / PATH_MAP, Path(po_dir) / PATHS_PO
    entries, head = po.load_or_create(str(po_file), args.target)
    known = spark.createDataFrame([(e["msgid"], e["msgstr"], "fuzzy" in e["flags"]) for e in entries if not e["obsolete"]], "segment string, msgstr string, fuzzy boolean")
    prior = spark.createDataFrame(list(paths.read_map(map_file.read_text(encoding="utf-8") if map_file.is_file() else None).items()), "src string, tgt string")
    written = documents.scan(spark, args.target_dir, args.glob).select("rel_path") if Path(args.target_dir).is_dir() else docs.select("rel_path").limit(0)
    prior = settled(paths.mirrored(docs, written, prior))
    mapped, catalog, asked = engine.translated_paths(docs.select("rel_path"), known, config, prior)
    mapped = settled(mapped)
    po.save(str(po_file), [{"msgctxt": f"path::segment::{r['segment']}", "msgid": r["segment"], "msgstr": r["msgstr"], "flags": ["fuzzy"] if r["fuzzy"] else [], "obsolete": False} for r in catalog.orderBy("segment").toLocalIterator()], head)
    documents.write(out.join(mapped.withColumnRenamed("src", "rel_path"), "rel_path").select(F.col("tgt").alias("rel_path"), "text"), args.target_dir)
    run = settled(mapped.withColumn("ok", F.lit(True)))
    gone = [r["tgt"] for r in paths.stale(prior, run).toLocalIterator()]
    rows = {r["src"]: r["tgt"] for r in paths.published(prior, run).toLocalIterator()}
    map_file.parent.mkdir(parents=True, exist_ok=True)
    map_file.write_text(paths.write_map(rows), encoding="utf-8")
    paths.removed(args.target_dir, gone)
    return asked


def _languages(spark: SparkSession, args: argparse.Namespace) -> int:
    began, langs = time.time(), language_names(args.langs)
    if not langs:
        raise ValueError("--langs names no language")
    outputs, catalogs = {}, {}
    for name, template, made in (("--target-template", args.target_template, outputs), ("--po-template", args.po_template, catalogs)):
        if template is None:
            continue
        if "{lang}" not in template:
            raise ValueError(f"{name} lacks {{lang}}")
        try:
            made |= {lang: Path(template.format(lang=lang)) for lang in langs}
        except (KeyError, IndexError, ValueError) as e:
            raise ValueError(f"{name} may hold {{lang}} and no other braces: {e}") from e
    catalogs = catalogs or {lang: path.with_suffix(".po") for lang, path in outputs.items()}
    _apart(source=args.source, **{f"target {x}": p for x, p in outputs.items()}, **{f"catalog {x}": p for x, p in catalogs.items()})
    if args.inplace:
        raise ValueError("inplace is for one language")
    args.target = langs[0]
    terms = _terms(args)
    config = engine.replace(_config(args), glossary=None)
    docs, old, heads = _one(spark, args.source), None, {}
    for lang in langs:
        one, heads[lang] = _catalog(spark, catalogs[lang], lang)
        one = one.withColumn("lang", F.lit(lang))
        old = one if old is None else old.union(one)
    result = engine.run_languages(docs, old, config, langs, {lang: engine.named_glossary(terms, None, lang) for lang in langs} if terms else None)
    by = {}
    for lang in langs:
        part = engine.Result(*[x.where(F.col("lang") == lang) for x in (result.documents, result.catalog, result.answers, result.coverage)])
        _stored(part, outputs[lang], catalogs[lang], heads[lang])
        by[lang] = {"target_path": outputs[lang], "po_path": catalogs[lang], "translation_stats": part.statistics(), "coverage": _covered(part)}
    _show({"source_path": args.source, "target_langs": langs, "by_lang": by})
    _billed(args, usage.receipt(args.model, result.statistics(), None, target_lang=",".join(langs), source_path=args.source, duration_seconds=time.time() - began))
    return int(any(x["translation_stats"]["failed"] for x in by.values()))


def _estimate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Entries, batches and tokens that a run of one file would ask for, without a call."""
    docs = _one(spark, args.source)
    entries = po.load_or_create(args.po)[0] if args.po else []
    old = spark.createDataFrame(po.commented_rows(0, entries), po.COMMENTED)
    todo = cat.pending(cat.reordered(cat.sync(blocks(docs), old)))
    row = batching.estimate(todo, max(args.batch_size, 1), args.batch_max_chars).drop("doc_id").first()
    found = row.asDict() if row else dict.fromkeys(("pending", "chars", "batches", "input_tokens", "output_tokens"), 0)
    rate = usage.rates(args.model, None)
    _show({"source_path": args.source, "model": args.model, **found, "input_rate": rate[0], "output_rate": rate[1]})
    return 0


def _report(spark: SparkSession, args: argparse.Namespace) -> int:
    entries, head = po.load_or_create(args.po)
    found, old = blocks(_one(spark, args.source)), spark.createDataFrame(po.commented_rows(0, entries), po.COMMENTED)
    rows = cat.coverage(found, old, "type").join(found.groupBy("type").agg(F.min("seq").alias("first")), "type")
    print(engine.report(args.source, rows, head.get("POT-Creation-Date")))
    return 0


def _checked(args: argparse.Namespace) -> None:
    if args.command.startswith("refine") and args.inplace:
        raise ValueError("refining never overwrites its source: drop --inplace")
    if getattr(args, "refine_first", False):
        if not args.refined:
            raise ValueError("--refine-first needs a place for the refined text")
        if not args.refine_lang:
            raise ValueError("--refine-first needs --refine-lang, the language of the source")
        if args.inplace:
            raise ValueError("--refine-first and --inplace exclude each other")


COMMANDS = {"translate": _file, "refine": _file, "translate-dir": _directory, "refine-dir": _directory, "translate-multi": _languages, "estimate": _estimate, "report": _report}


def main(argv: list[str] | None = None) -> int:
    """0, 1 when an entry failed, 2 for wrong usage. A run that breaks off prints what it was billed for."""
    args = parser().parse_args(argv)
    try:
        _checked(args)
        spark = SparkSession.builder.appName("verdigris").getOrCreate()
        return COMMANDS[args.command](spark, args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        if receipt := getattr(e, "partial_receipt", None):
            _billed(args, receipt)
        raise


if __name__ == "__main__":
    sys.exit(main())
