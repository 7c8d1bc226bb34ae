"""What a worker does for one document: groups in order, reference pairs, glossary, calls, fallbacks, checks.

A group sees the pairs that the catalog starts with and those committed before it, so a document's groups run one after
the other and documents side by side. Everything that a call was billed for leaves the worker with its answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd

from . import batching, placeholders, translate
from .pool import MAX_REFERENCES, Pool
from .prompts import Prompt, glossary_block
from .usage import counted
from .validate import Issue, reasons, round_trip, stability, validate

#: Takes chat messages and options, returns a text, or a reply with text and usage.
Chat = Callable[[list[dict], dict], object]

ANSWERS = "doc_id long, msgctxt string, lang string, source string, answer string, failed boolean, reason string, echo boolean, calls int, per_entry int, input_tokens long, output_tokens long, error string"
_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]


@dataclass
class Used:
    calls: int = 0
    per_entry: int = 0
    input_tokens: int = 0
    output_tokens: int = 0


@dataclass(frozen=True)
class Model:
    """How a model is reached: chat with whole messages, or the plain calls that take a payload or a text."""

    batch: translate.BatchCall | None = None
    single: translate.SingleCall | None = None
    chat: Chat | None = None

    def _reply(self, messages: list[dict], options: dict, used: Used) -> str:
        reply = self.chat(messages, options)
        if isinstance(reply, str):
            return reply
        get = reply.get if isinstance(reply, dict) else lambda name, other=None: getattr(reply, name, other)
        usage = get("usage") or {}
        field_ = usage.get if isinstance(usage, dict) else lambda name, other=None: getattr(usage, name, other)
        used.input_tokens += counted(field_("prompt_tokens", 0))
        used.output_tokens += counted(field_("completion_tokens", 0))
        return get("text")

    def ask_batch(self, items: dict[str, str], messages: Callable[[dict], list[dict]], options: dict, used: Used) -> str:
        used.calls += 1
        return self._reply(messages(items), options, used) if self.chat else self.batch(json.dumps(items, ensure_ascii=False))

    def ask_one(self, text: str, messages: Callable[[str], list[dict]], options: dict, used: Used) -> str | None:
        if self.chat is None and self.single is None:
            return None
        used.calls += 1
        used.per_entry += 1
        return self._reply(messages(text), options, used) if self.chat else self.single(text)

    @property
    def has_single(self) -> bool:
        return self.chat is not None or self.single is not None


@dataclass(frozen=True)
class Rules:
    """What holds for every document of a run."""

    model: Model
    prompt: Prompt = field(default_factory=Prompt)
    validation: str = "off"
    glossary_mode: str = "placeholder"
    user: placeholders.Registry | None = None
    post_process: Callable[[str], str] | None = None
    batch_size: int = batching.BATCH_SIZE
    batch_chars: int = batching.BATCH_CHARS
    pairs: int = MAX_REFERENCES


def decoded(text: str, mapping: list[tuple]) -> str:
    back = {token: original if form is None else form for token, original, _, form in mapping}
    return placeholders.TOKEN.sub(lambda m: back.get(m[0], m[0]), text)


def found_issues(rules: Rules, registry: placeholders.Registry, lang: str, terms: dict[str, str | None], source: str, encoded: str, answer: str, mapping: list[tuple]) -> list[Issue]:
    """Everything that keeps an answer from being committed, one issue for a check."""
    refine = rules.prompt.mode == "refine"
    found = []
    if mapping:
        lost = round_trip(encoded, mapping)
        moved = placeholders.drift(source, answer, registry)
        found += [Issue("placeholder_roundtrip", lost)] if lost else []
        found += [Issue("placeholder_position", "; ".join(moved))] if moved else []
    if refine and (drifted := stability(source, answer)):
        found.append(drifted)
    if rules.validation != "off":
        have = {i.check for i in found}
        found += [i for i in validate(source, answer, target_lang=lang, glossary=terms, strict=rules.validation == "strict", purpose=rules.prompt.mode) if i.check not in have]
    return found


class Document:
    """One document's run in one or several languages."""

    def __init__(self, rules: Rules, langs: list[str] | None, terms: dict[str, dict[str, str | None]], pools: dict[str, Pool]):
        self.rules, self.multi = rules, langs is not None
        self.langs = langs or [rules.prompt.lang]
        self.terms, self.pools, self.used, self.rows = terms, pools, Used(), []
        coded = terms.get(self.langs[0]) if rules.glossary_mode == "placeholder" and not self.multi else None
        self.registry = placeholders.effective(rules.user, coded)

    def _encoded(self, text: str) -> tuple[str, list[tuple]]:
        encoded, mapping = self.registry.encode(text)
        terms = self.terms.get(self.langs[0]) or {}
        return encoded, [(t, o, n, (terms.get(o) or o) if n == "glossary" else None) for t, o, n, _ in mapping]

    def _block(self, texts: list[str], lang: str) -> str | None:
        return glossary_block("\n".join(texts), self.terms.get(lang)) if self.rules.glossary_mode == "instruction" else None

    def _prompt(self, lang: str) -> Prompt:
        return Prompt(**{**self.rules.prompt.__dict__, "lang": lang})

    def _batched(self, entries: list[dict], coded: dict[str, str]) -> dict:
        """Answers of a group by context id; a chunk of encoded texts is one call, bisected where its answer is unusable."""
        raw = [e["msgid"] for e in entries]
        pairs = {lang: self.pools[lang].shared(raw, self.rules.pairs) for lang in self.langs}
        blocks = {lang: self._block(raw, lang) for lang in self.langs}
        prompt, lang = self.rules.prompt, self.langs[0]
        if self.multi:
            messages = lambda items: prompt.multi(items, self.langs, pairs, blocks)
        else:
            messages = lambda items: prompt.batch(items, pairs[lang], blocks[lang])
        ask = lambda payload: self.rules.model.ask_batch(json.loads(payload), messages, prompt.options(True), self.used)
        worker, out, names = translate.BatchTranslator(ask, self.langs if self.multi else None), {}, list(coded)
        for lo, hi in batching.chunk_cuts([coded[n] for n in names], self.rules.batch_size, self.rules.batch_chars):
            out |= worker.translate({n: coded[n] for n in names[lo:hi]})
        return out

    def _alone(self, entry: dict, encoded: str, lang: str) -> str | None:
        prompt = self._prompt(lang)
        pairs = [(src, tgt) for _, src, tgt in self.pools[lang].similar(entry["msgid"], self.rules.pairs)]
        return self.rules.model.ask_one(encoded, lambda text: prompt.one(text, pairs, self._block([entry["msgid"]], lang)), prompt.options(False), self.used)

    def _settle(self, entry: dict, lang: str, raw: str | None, encoded: str, mapping: list[tuple]) -> None:
        answer, failed, reason, error = None, True, None, None
        try:
            if raw is None and self.rules.model.has_single:
                raw = self._alone(entry, encoded, lang)
            if raw is not None and self.rules.post_process is not None:
                raw = self.rules.post_process(raw)
            if raw is not None:
                answer = decoded(raw, mapping)
                issues = found_issues(self.rules, self.registry, lang, self.terms.get(lang) or {}, entry["msgid"], raw, answer, mapping)
                failed, reason = bool(issues), f"validator: {reasons(issues)}" if issues else None
        except Exception as e:  # one entry's failure stays with it
            answer, error = None, f"{type(e).__name__}: {e}"
        kind = entry["msgctxt"].split("::", 1)[-1].split(":", 1)[0]
        echo = answer is not None and answer.strip() == entry["msgid"].strip() and kind != "code" and self.rules.prompt.mode != "refine"
        if answer is not None and not failed:
            self.pools[lang].add(entry["msgid"], answer)
        self.rows.append([entry["doc_id"], entry["msgctxt"], lang, entry["msgid"], answer, failed, reason, echo, 0, 0, 0, 0, error])

    def run(self, entries: list[dict]) -> list[list]:
        """Rows of ANSWERS; what the document was billed for stands in its first row."""
        sections = [e["msgctxt"].split("::", 1)[0].split("/", 1)[0] for e in entries]
        size = self.rules.batch_size
        for lo, hi in batching.section_cuts([e["msgid"] for e in entries], sections, max(size, 1), self.rules.batch_chars):
            group = entries[lo:hi]
            coded = {e["msgctxt"]: self._encoded(e["msgid"]) for e in group}
            answers = self._batched(group, {k: v[0] for k, v in coded.items()}) if size > 0 else {}
            for e in group:
                given = answers.get(e["msgctxt"])
                for lang in self.langs:
                    if lang in e["langs"]:
                        raw = given.get(lang) if isinstance(given, dict) else given
                        self._settle(e, lang, raw, *coded[e["msgctxt"]])
        if self.rows:
            self.rows[0][8:12] = [self.used.calls, self.used.per_entry, self.used.input_tokens, self.used.output_tokens]
        return self.rows


def document_worker(rules: Rules, langs: list[str] | None = None, glossaries: dict[str, dict[str, str | None]] | None = None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For cogrouped (entries, pool) of a document: entries are (doc_id, at, msgctxt, msgid, langs); pool rows are
    (doc_id, ord, lang, src, tgt), or a glossary of the document's own as JSON in src where tgt is null."""
    own = langs or [rules.prompt.lang]

    def run(asked: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame([], columns=_NAMES)
        pool = pool.sort_values("ord", kind="stable")
        terms = dict(glossaries or {})
        for src, tgt, lang in zip(pool["src"], pool["tgt"], pool["lang"]):
            if tgt is None:
                terms[lang] = json.loads(src)
        pairs = pool[pool["tgt"].notna()]
        pools = {lang: Pool([(s, t) for s, t, x in zip(pairs["src"], pairs["tgt"], pairs["lang"]) if x == lang]) for lang in own}
        asked = asked.sort_values("at", kind="stable")
        rows = Document(rules, langs, terms, pools).run(asked.to_dict("records"))
        return pd.DataFrame(rows, columns=_NAMES)

    return run
