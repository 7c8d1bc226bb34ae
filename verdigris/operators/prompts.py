"""What a model is told: instructions, glossary, example pairs and the text, as chat messages."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

Pairs = Iterable[tuple[str, str]]

_KEEP = """- Markdown marks stay as they are: heading signs, bullets, table bars, emphasis, links, fences, backticks.
- Code stays code. Names, paths, commands and URLs are not touched; comments and messages that people read are.
- A backticked word that names a button or a menu is read by people and belongs to the prose; one that is typed is code.
- Format fields such as {{name}}, %s or ${{var}} are copied letter by letter.
- Tokens like \u27e6P:0\u27e7 stand for protected text. Each appears in the answer exactly as often as in the input, unchanged."""
_JSON = """- The input is one JSON object: block keys and Markdown texts.
- The answer is one JSON object with these same keys, in the same order, and nothing around it: no fence, no remark."""

TRANSLATE_RULES = f"Put the prose of this Markdown into the target language.\n{_KEEP}\n- Well-known technical terms may stay in English where readers expect that."
BATCH_TRANSLATE_RULES = f"{TRANSLATE_RULES}\n{_JSON}\n- One voice and one set of terms throughout all values."
REFINE_RULES = f"Improve grammar, clarity and flow of this Markdown; its language and its meaning stay.\n{_KEEP}\n- Nothing is added and nothing is left out."
BATCH_REFINE_RULES = f"{REFINE_RULES}\n{_JSON}\n- One voice and one set of terms throughout all values."
MULTI_RULES = f"""Put the prose of these Markdown blocks into each of the languages {{langs}}.
{_KEEP}
{_JSON}
- Every value of the answer is an object again: the language codes {{langs}} as keys, that language's text as value."""

_ROLE = "You {job}. Answer with the result alone.\n\n{rules}\n"
TRANSLATE_SYSTEM = _ROLE.replace("{job}", "translate technical documents into {lang}")
BATCH_TRANSLATE_SYSTEM = _ROLE.replace("{job}", "translate sets of blocks of technical documents into {lang}")
REFINE_SYSTEM = _ROLE.replace("{job}", "edit technical documents written in {lang}")
BATCH_REFINE_SYSTEM = _ROLE.replace("{job}", "edit sets of blocks of technical documents written in {lang}")
MULTI_SYSTEM = _ROLE.replace("{job}", "translate sets of blocks of technical documents into several languages at once: {lang}")


def takes_cache_marks(model: str) -> bool:
    """Whether a model's provider reads a cache mark on a part of a message; others reject messages of that shape."""
    name = (model or "").lower()
    return name.startswith(("anthropic/", "claude")) or "/claude" in name or "anthropic." in name


def relevant_terms(text: str, glossary: dict[str, str | None] | None) -> dict[str, str | None]:
    """Terms that occur in a text, as plain substrings."""
    return {k: v for k, v in (glossary or {}).items() if k in text}


def glossary_block(text: str, glossary: dict[str, str | None] | None) -> str | None:
    """The lines that bind a model to a glossary; None if no term occurs."""
    lines = [f'* "{k}": ' + ("leave as it is" if v is None else f'always "{v}"') for k, v in relevant_terms(text, glossary).items()]
    return "\n".join(["Terms and the only forms allowed for them:", *lines]) if lines else None


def _examples(title: str, pairs: Pairs | None) -> list[str]:
    lines = [f"* {src}\n  => {tgt}" for src, tgt in pairs or ()]
    return ["\n".join([title, *lines])] if lines else []


@dataclass(frozen=True)
class Prompt:
    """Messages for one model. extra is added to the rules; cache asks for a mark on the part that repeats."""

    lang: str = "en"
    mode: str = "translate"
    extra: str = ""
    model: str = ""
    cache: bool = False
    json_mode: bool = False

    def _system(self, template: str, rules: str, lang: str, *parts: str | None) -> dict:
        rules = rules.replace("{langs}", lang).replace("{{", "{").replace("}}", "}")
        rules = "\n".join([rules, self.extra] if self.extra else [rules])
        text = template.replace("{lang}", lang).replace("{rules}", rules)
        text = "\n\n".join([text.rstrip("\n"), *(p for p in parts if p)])
        if self.cache and takes_cache_marks(self.model):
            return {"role": "system", "content": [{"type": "text", "text": text, "cache_control": {"type": "ephemeral"}}]}
        return {"role": "system", "content": text}

    def options(self, batch: bool) -> dict:
        """Settings of a call: a JSON answer is asked for only of models that are known to give one."""
        return {"model": self.model, **({"response_format": {"type": "json_object"}} if batch and self.json_mode else {})}

    def one(self, text: str, pairs: Pairs | None = None, block: str | None = None) -> list[dict]:
        """For a single text: pairs come as turns of the conversation."""
        template, rules = (REFINE_SYSTEM, REFINE_RULES) if self.mode == "refine" else (TRANSLATE_SYSTEM, TRANSLATE_RULES)
        turns = [m for src, tgt in pairs or () for m in ({"role": "user", "content": src}, {"role": "assistant", "content": tgt})]
        return [self._system(template, rules, self.lang, block), *turns, {"role": "user", "content": text}]

    def batch(self, items: dict[str, str], pairs: Pairs | None = None, block: str | None = None) -> list[dict]:
        """For a batch: pairs are listed in the instructions."""
        template, rules = (BATCH_REFINE_SYSTEM, BATCH_REFINE_RULES) if self.mode == "refine" else (BATCH_TRANSLATE_SYSTEM, BATCH_TRANSLATE_RULES)
        return [self._system(template, rules, self.lang, block, *_examples("Earlier translations to stay in tune with:", pairs)), payload(items)]

    def multi(self, items: dict[str, str], langs: list[str], pairs: dict[str, Pairs | None], blocks: dict[str, str | None]) -> list[dict]:
        """For several languages in one call: glossaries and pairs are labelled by language."""
        parts = [f"[{lang}] {blocks[lang]}" for lang in langs if blocks.get(lang)]
        parts += [p for lang in langs for p in _examples(f"Earlier {lang} translations to stay in tune with:", pairs.get(lang))]
        return [self._system(MULTI_SYSTEM, MULTI_RULES, ", ".join(langs), *parts), payload(items)]


def payload(items: dict[str, str]) -> dict:
    return {"role": "user", "content": json.dumps(items, ensure_ascii=False)}
