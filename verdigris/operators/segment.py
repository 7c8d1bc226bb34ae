"""Segmentation of Markdown into blocks: one document in, its blocks out.

The grammar is a fold over lines with look-ahead inside lists, so it runs in Python, over Arrow batches of whole
documents; everything after it is relational.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = "doc_id long, seq int, type string, text string, start_line int, end_line int, path string, idx int, msgctxt string"

#: Characters of text in a batch of blocks that leaves a worker; a block's other columns count as ROW_CHARS.
OUT_CHARS, ROW_CHARS = 1 << 20, 200

_FENCE = re.compile(r"```|~~~")
_HEADING = re.compile(r"(?P<marks>#{1,6})\s+(?P<title>.*)")
_RULE = re.compile(r"\s*(?:-\s*(?:-\s*){2,}|\*\s*(?:\*\s*){2,}|_\s*(?:_\s*){2,})$")
_ITEM = re.compile(r"(\s*)(?:([-*+])|(\d+\.))\s+")
_ROW = re.compile(r"\s*\|")


def slug(title: str) -> str:
    kept = re.sub(r"[^-\w\s]", "", title.lower())
    return re.sub(r"\s+", "-", kept).strip("-") or "section"


def kind_of(line: str) -> str:
    """What a line opens when no block is open; the first rule that matches wins."""
    if _FENCE.match(line.strip()):
        return "code"
    if _HEADING.match(line):
        return "heading"
    if _RULE.match(line):
        return "hr"
    if line.lstrip().startswith(">"):
        return "quote"
    if item := _ITEM.match(line):
        return "olist" if item[3] else "ulist"
    if _ROW.match(line):
        return "table"
    return "para" if line.strip() else "blank"


def _end_of_code(lines: list[str], at: int) -> int:
    fence = lines[at].strip()[:3]
    for k in range(at + 1, len(lines)):
        if lines[k].strip().startswith(fence):
            return k + 1
    return len(lines)


def _end_of_list(lines: list[str], at: int) -> int:
    first = _ITEM.match(lines[at])
    indent, ordered = len(first[1]), first[3] is not None

    def other_list(item: re.Match) -> bool:
        return len(item[1]) == indent and (item[3] is not None) != ordered

    k = at + 1
    while k < len(lines):
        kind, item = kind_of(lines[k]), _ITEM.match(lines[k])
        if item:
            # A rule such as "- - -" also reads as an item here.
            if other_list(item) or len(item[1]) < indent:
                break
        elif kind == "blank":
            ahead = next((x for x in lines[k + 1 :] if x.strip()), "")
            item = _ITEM.match(ahead)
            if not item or other_list(item):
                break
        elif kind != "para" or lines[k].startswith("#") and not lines[k].startswith(" " * (indent + 2)):
            break
        k += 1
    return k


def _end_of(kind: str, lines: list[str], at: int) -> int:
    if kind in ("heading", "hr"):
        return at + 1
    if kind == "code":
        return _end_of_code(lines, at)
    if kind in ("olist", "ulist"):
        return _end_of_list(lines, at)
    goes_on = {"quote": lambda x: x.lstrip().startswith(">"), "table": lambda x: "|" in x, "para": lambda x: kind_of(x) == "para"}[kind]
    k = at + 1
    while k < len(lines) and goes_on(lines[k]):
        k += 1
    return k


def segment(lines: list[str]) -> list[dict]:
    """Blocks of a document: type, text, start, end (half-open line numbers), path, idx and msgctxt.

    path is the list of heading slugs above; a slug that repeats under the same parents gets -1, -2 and so on. A
    heading that skips levels is appended to the path as it is.
    """
    path: list[str] = []
    seen: dict[int, Counter] = {}
    ordinals: Counter = Counter()
    blocks, at = [], 0
    while at < len(lines):
        kind = kind_of(lines[at])
        if kind == "blank":
            at += 1
            continue
        end = _end_of(kind, lines, at)
        if kind == "heading":
            marks, title = _HEADING.match(lines[at]).groups()
            level = len(marks)
            name = slug(title)
            for deeper in [x for x in seen if x > level]:
                del seen[deeper]
            used = seen.setdefault(level, Counter())
            used[name] += 1
            if used[name] > 1:
                name = f"{name}-{used[name] - 1}"
            path = [*path[: level - 1], name]
        where = "/".join(path)
        idx = ordinals[where, kind]
        ordinals[where, kind] += 1
        blocks.append({"type": kind, "text": "\n".join(lines[at:end]), "start": at, "end": end, "path": list(path), "idx": idx, "msgctxt": f"{where}::{kind}:{idx}"})
        at = end
    return blocks


def text_lines(text: str) -> list[str]:
    """Lines without their newline; a newline at the end opens no further line."""
    return [x.rstrip("\n") for x in text.splitlines(keepends=True)]


def text_blocks(text: str) -> list[dict]:
    return segment(text_lines(text))


def _segment(batches: Iterator[pa.RecordBatch], name: Callable[[dict], str] | None, cut: Callable[..., list[dict]], also: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """One document at a time is text and blocks here; what is made goes on as soon as it holds OUT_CHARS."""
    kinds = {"doc_id": pa.int64(), "seq": pa.int32(), "type": pa.string(), "text": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "path": pa.string(), "idx": pa.int32(), "msgctxt": pa.string()}
    out: dict[str, list] = {k: [] for k in kinds}
    held = 0

    def made() -> pa.RecordBatch:
        nonlocal held
        found = pa.record_batch([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))
        for v in out.values():
            v.clear()
        held = 0
        return found

    for batch in batches:
        for doc, text, *more in zip(batch.column("doc_id"), batch.column("text"), *map(batch.column, also)):
            doc = doc.as_py()
            for seq, b in enumerate(cut(text.as_py() or "", *[x.as_py() for x in more])):
                path = None if b["path"] is None else "/".join(b["path"])
                for k, v in zip(out, (doc, seq, b["type"], b["text"], b["start"], b["end"], path, b["idx"], name(b) if name else b["msgctxt"])):
                    out[k].append(v)
                held += len(b["text"] or "") + ROW_CHARS
                if held > OUT_CHARS:
                    yield made()
    if out["doc_id"]:
        yield made()


def blocks(docs: DataFrame, name: Callable[[dict], str] | None = None, cut: Callable[..., list[dict]] = text_blocks, also: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of (doc_id, text) documents; null and empty texts have none. name makes other context ids than msgctxt,
    cut makes other blocks of a text than the grammar's, from the text and the columns also."""
    return docs.select("doc_id", "text", *also).mapInArrow(partial(_segment, name=name, cut=cut, also=also), BLOCKS)
