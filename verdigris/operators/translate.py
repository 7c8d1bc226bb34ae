"""Calls to a translator: batches with bisection, single fallback, several target languages at once."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Takes {key: text} as JSON and returns the model's answer, JSON of the same keys; takes one text and returns one.
BatchCall = Callable[[str], str]
SingleCall = Callable[[str], str]

ANSWERS = "doc_id long, msgctxt string, answer string, calls int, error string"


def salvage(raw: str) -> dict:
    """The JSON object in an answer: as it is, without a code fence, or between the outermost braces; else {}."""
    tries = [raw]
    if fenced := re.match(r"\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", raw, re.S):
        tries.append(fenced[1])
    if "{" in raw and "}" in raw:
        tries.append(raw[raw.index("{") : raw.rindex("}") + 1])
    for text in tries:
        try:
            if isinstance(found := json.loads(text), dict):
                return found
        except ValueError:
            continue
    return {}


class BatchTranslator:
    """Translates a batch; what an answer lacks is asked again, an unusable answer is bisected."""

    def __init__(self, call: BatchCall, languages: list[str] | None = None):
        self.call, self.languages, self.calls = call, languages, 0

    def _usable(self, value: object) -> object | None:
        if self.languages is None:
            return value if isinstance(value, str) else None
        if not isinstance(value, dict):
            return None
        return {k: v for k, v in value.items() if k in self.languages and isinstance(v, str)} or None

    def translate(self, items: dict[str, str]) -> dict:
        if not items:
            return {}
        self.calls += 1
        try:
            answer = salvage(self.call(json.dumps(items, ensure_ascii=False)))
        except Exception:  # a failed call is an unusable answer
            answer = {}
        good = {k: u for k in items if (u := self._usable(answer.get(k))) is not None}
        rest = {k: v for k, v in items.items() if k not in good}
        # One missing key is left to the single fallback; so is a batch of one.
        if len(items) <= 1 or len(rest) <= 1:
            return good
        keys = list(rest)
        half = len(keys) // 2
        for part in (keys[:half], keys[half:]):
            good |= self.translate({k: rest[k] for k in part})
        return good


def _group(batch: BatchCall, single: SingleCall | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        worker = BatchTranslator(batch)
        answers = worker.translate(dict(zip(pdf["msgctxt"], pdf["msgid"])))
        calls, rows = worker.calls, []
        for doc, ctx, text in zip(pdf["doc_id"], pdf["msgctxt"], pdf["msgid"]):
            error = None
            if ctx not in answers and single is not None:
                calls += 1
                try:
                    answers[ctx] = single(text)
                except Exception as e:  # one entry's failure stays with it
                    error = f"{type(e).__name__}: {e}"
            rows.append((doc, ctx, answers.get(ctx), 0, error))
        if rows:
            rows[0] = (*rows[0][:3], calls, rows[0][4])
        return pd.DataFrame(rows, columns=["doc_id", "msgctxt", "answer", "calls", "error"])

    return run


def translated(groups: DataFrame, batch: BatchCall, single: SingleCall | None = None) -> DataFrame:
    """(doc_id, msgctxt, answer, calls, error) of entries grouped by (doc_id, group_no); calls stand in a group's first
    row. Executors run the groups side by side."""
    return groups.groupBy("doc_id", "group_no").applyInPandas(_group(batch, single), ANSWERS)


def translated_multi(groups: DataFrame, batch: BatchCall, languages: list[str]) -> DataFrame:
    """(doc_id, msgctxt, lang, answer): all languages in one call for a group; what is missing has no row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        answers = BatchTranslator(batch, languages).translate(dict(zip(pdf["msgctxt"], pdf["msgid"])))
        rows = [(pdf["doc_id"].iloc[0], ctx, lang, text) for ctx, by in answers.items() for lang, text in by.items()]
        return pd.DataFrame(rows, columns=["doc_id", "msgctxt", "lang", "answer"])

    return groups.groupBy("doc_id", "group_no").applyInPandas(run, "doc_id long, msgctxt string, lang string, answer string")


def echo(payload: str) -> str:
    """Offline translator: '[T] ' before every text."""
    return json.dumps({k: f"[T] {v}" for k, v in json.loads(payload).items()}, ensure_ascii=False)


def echo_one(text: str) -> str:
    return f"[T] {text}"


def messages(system: str, text: str, pairs: list[tuple[str, str]]) -> Iterator[dict]:
    """Chat messages: instructions, reference pairs as turns, the text."""
    yield {"role": "system", "content": system}
    for src, tgt in pairs:
        yield {"role": "user", "content": src}
        yield {"role": "assistant", "content": tgt}
    yield {"role": "user", "content": text}
