"""Checks of one translation, with their reasons: the same rules as functions.text.issues(), inside a worker."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from ..functions.text import FAMILIES, PROSE, SCRIPTS
from . import placeholders

_HEADING = re.compile(r"(#{1,6})\s")
_SCRIPT = {k: re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]}", v)) for k, v in SCRIPTS.items()}


class Issue(NamedTuple):
    check: str
    detail: str


def languages(text: str) -> set[str]:
    return {k for k, r in _SCRIPT.items() if r.search(text)}


def families(text: str) -> set[str]:
    found = languages(text)
    return {f for f, scripts in FAMILIES.items() if found.intersection(scripts)}


def dominant_family(text: str) -> str | None:
    counts = {f: sum(len(_SCRIPT[s].findall(text)) for s in scripts) for f, scripts in FAMILIES.items()}
    best = max(counts.values())
    return next((f for f, n in counts.items() if n == best), None) if best else None


def stability(source: str, output: str) -> Issue | None:
    """Whether an edit in one language brings in another script, or loses the one that most of the text is in."""
    before, after = families(source), families(output)
    if not before or not after:
        return None
    if after - before:
        return Issue("language_stability", f"new scripts: {', '.join(sorted(after - before))}")
    main = dominant_family(source)
    return Issue("language_stability", f"lost script: {main}") if main not in after else None


def round_trip(encoded: str, mapping: list[tuple]) -> str | None:
    """How the tokens of an answer differ from those of its map; an empty map passes anything."""
    if not mapping:
        return None
    want, have = Counter(m[0] for m in mapping), Counter(m[0] for m in placeholders.TOKEN.finditer(encoded))
    lost, more = want - have, {t: have[t] for t in want if have[t] > want[t]}
    parts = [("missing", [t + (f"x{n}" if n > 1 else "") for t, n in lost.items()]), ("duplicated", [f"{t}x{n}" for t, n in more.items()]), ("unexpected", [t for t in have if t not in want])]
    return "; ".join(f"{name}={','.join(found)}" for name, found in parts if found) or None


def validate(source: str, output: str, *, target_lang: str, glossary: dict[str, str | None] | None = None, strict: bool = False, purpose: str = "translate", mapping: list[tuple] | None = None, encoded: str | None = None) -> list[Issue]:
    """All checks of a translation in order; a map of placeholders needs the answer as it was before decoding."""
    if purpose not in ("translate", "refine"):
        raise ValueError(f"{purpose!r} is neither translate nor refine")
    if mapping and encoded is None:
        raise ValueError("a map of placeholders needs the encoded answer")
    found = []
    if mapping and (lost := round_trip(encoded, mapping)):
        found.append(Issue("placeholder_roundtrip", lost))
    levels = [len(m[1]) if (m := _HEADING.match(t)) else None for t in (source, output)]
    if levels[0] != levels[1]:
        found.append(Issue("heading_level", f"{levels[0]} became {levels[1]}"))
    fences = [len(re.findall("(?m)^(?:```|~~~)", t)) for t in (source, output)]
    if fences[0] != fences[1]:
        found.append(Issue("fence_count", f"{fences[0]} became {fences[1]}"))
    found += [Issue("glossary_preserve", f"{t!r} is gone") for t, form in (glossary or {}).items() if form is None and t in source and t not in output]
    tag, plain, made = target_lang.split("-")[0].lower(), source.strip(), output.strip()
    if purpose == "refine":
        found += [x for x in (stability(source, output),) if x]
    elif tag in ("zh", "ja", "ko") and plain and made and languages(source) == {"en"} and not _SCRIPT[tag].search(output):
        if plain != made or set(re.findall("[a-z]+", source.lower())).intersection(PROSE):
            found.append(Issue("target_language", f"no {target_lang} character"))
    if strict:
        spans = [len(re.findall("`[^`\n]+`", t)) for t in (source, output)]
        if spans[0] != spans[1]:
            found.append(Issue("inline_code_count", f"{spans[0]} became {spans[1]}"))
    return found


def reasons(issues: list[Issue]) -> str:
    return "; ".join(f"{i.check}: {i.detail}" for i in issues)
