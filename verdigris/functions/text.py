"""Column expressions for text, scripts, slugs and validation counts: all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]"
SCRIPTS = {
    "en": "[A-Za-z]",
    "ja": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}]",
    "ko": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}]",
    "zh": r"[\x{4E00}-\x{9FFF}]",
}
FAMILIES = {"cjk": ("ja", "zh"), "korean": ("ko",), "latin": ("en",)}
PROSE = (
    "the of and to in is for on that with as are be this by from at it or an was not have has but you your can will "
    "we our they their its if then so do does did had been being were these those should would could a"
).split()
TOKEN = r"\x{27E6}P:(\d+)\x{27E7}"


def language_names(text: str) -> list[str]:
    """Languages of a comma-separated list in its order, without blanks and repeats."""
    return list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def slug(text: Column) -> Column:
    """Heading slug: letters, digits, underscores and hyphens in lower case; 'section' if nothing stays."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), "^-+|-+$", "")
    return F.when(joined == "", "section").otherwise(joined)


def path_slug(text: Column) -> Column:
    """File-name slug of text in NFC: no control or reserved characters, no reserved device name."""
    s = F.regexp_replace(trimmed(text), r"\s+", "-")
    s = F.regexp_replace(s, r'[\x00-\x1f<>:"/\\|?*]', "")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^[-. ]+|[-. ]+$", "")
    return F.regexp_replace(s, r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)", "$1_$2")


def safe_segment(raw: Column) -> Column:
    """Fallback name of a path segment whose translation leaves nothing usable."""
    return F.concat(F.lit("segment-"), F.left(F.sha1(raw), F.lit(8)))


def heading_level(text: Column) -> Column:
    """1 to 6, or null for what is no heading."""
    return F.nullif(F.length(F.regexp_extract(text, r"^(#{1,6})\s", 1)), F.lit(0))


def fences(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^(```|~~~)"))


def inline_code(text: Column) -> Column:
    return F.regexp_count(text, F.lit("`[^`\n]+`"))


def primary_subtag(locale: Column) -> Column:
    return F.lower(F.split_part(locale, F.lit("-"), F.lit(1)))


def languages(text: Column) -> Column:
    """Detected languages, by script, in alphabetical order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SCRIPTS.items()]))


def contains_language(text: Column, locale: Column) -> Column:
    """Whether any character of the locale's script occurs; unknown locales never match."""
    tag = primary_subtag(locale)
    return reduce(lambda a, kv: a.when(tag == kv[0], text.rlike(kv[1])), SCRIPTS.items(), F.when(F.lit(False), F.lit(False))).otherwise(False)


def families(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [text.rlike(SCRIPTS[s]) for s in scripts]), F.lit(f)) for f, scripts in FAMILIES.items()]))


def dominant_family(text: Column) -> Column:
    """Script family with most characters; ties in the order of FAMILIES; null without any."""
    counts = {f: reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(SCRIPTS[s])) for s in scripts]) for f, scripts in FAMILIES.items()}
    most = F.greatest(*counts.values())
    return reduce(lambda a, kv: a.when(kv[1] == most, F.lit(kv[0])), counts.items(), F.when(most == 0, F.lit(None).cast("string")))


def english_prose(text: Column) -> Column:
    """Whether a common English function word occurs."""
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, PROSE)))


def block_type(msgctxt: Column) -> Column:
    return F.regexp_extract(msgctxt, "::([^:]*):", 1)


def legacy_block_type(context: Column) -> Column:
    """What stands behind the first '::', number included; 'unknown' without one."""
    return F.when(F.contains(context, F.lit("::")), F.split_part(context, F.lit("::"), F.lit(2))).otherwise("unknown")


def top_section(msgctxt: Column) -> Column:
    return F.substring_index(F.substring_index(msgctxt, "::", 1), "/", 1)


def context_id(path: Column, kind: Column, idx: Column) -> Column:
    return F.concat(F.array_join(path, "/"), F.lit("::"), kind, F.lit(":"), idx.cast("string"))


def language_list(csv: Column) -> Column:
    """Comma-separated languages: trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != ""))


def salvage_json(raw: Column) -> Column:
    """The JSON object in a model's answer: as it is, without its code fence, or the outermost braces; else null."""
    bare = F.regexp_extract(raw, r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)

    def parsed(text: Column) -> Column:
        return F.when(text.rlike(r"(?s)^\s*\{"), F.when(F.try_parse_json(text).isNotNull(), text))

    return F.coalesce(parsed(raw), parsed(bare), parsed(inner))


def issues(source: Column, output: Column, target: Column, strict: Column, refine: Column, kept_terms: Column) -> Column:
    """Names of the checks that a translation fails, in order. kept_terms: terms that must stay as they are."""
    plain, made = trimmed(source), trimmed(output)
    levels = ~heading_level(source).eqNullSafe(heading_level(output))
    lost = F.size(F.filter(kept_terms, lambda t: F.contains(source, t) & ~F.contains(output, t)))
    tag = primary_subtag(target)
    english = F.array_join(languages(source), ",") == "en"
    wrong = tag.isin("zh", "ja", "ko") & (plain != "") & (made != "") & english & ~contains_language(output, target)
    wrong = wrong & ((plain != made) | english_prose(source))
    checks = F.array(
        F.when(levels, F.lit("heading_level")),
        F.when(fences(source) != fences(output), F.lit("fence_count")),
    )
    checks = F.concat(checks, F.array_repeat(F.lit("glossary_preserve"), lost))
    checks = F.concat(
        checks,
        F.array(
            F.when(~refine & wrong, F.lit("target_language")),
            F.when(refine & unstable(source, output), F.lit("language_stability")),
            F.when(strict & (inline_code(source) != inline_code(output)), F.lit("inline_code_count")),
        ),
    )
    return F.array_compact(checks)


def unstable(source: Column, output: Column) -> Column:
    """Whether a same-language edit brings a new script family or loses the dominant one."""
    before, after = families(source), families(output)
    main = dominant_family(source)
    new = F.size(F.array_except(after, before)) > 0
    gone = main.isNotNull() & ~F.coalesce(F.array_contains(after, main), F.lit(False))
    return (F.size(before) > 0) & (F.size(after) > 0) & (new | gone)
