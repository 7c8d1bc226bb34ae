"""Bounded batches of pending entries, and what a run would cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import top_section

BATCH_SIZE, BATCH_CHARS = 40, 8000

# A greedy cut depends on every cut before it, so each document's entries fold in order; the fold stays in the JVM. It
# keeps the places where groups begin: a number for a group, not one for an entry.
_FOLD = """
aggregate(items,
  struct(0 AS i, 0 AS n, 0 AS chars, cast(NULL AS string) AS section, cast(array() AS array<int>) AS starts),
  (s, x) -> IF(s.i = 0 OR {flush},
    named_struct('i', s.i + 1, 'n', 1, 'chars', x.len, 'section', x.section, 'starts', s.starts || array(s.i)),
    named_struct('i', s.i + 1, 'n', s.n + 1, 'chars', s.chars + x.len, 'section', x.section, 'starts', s.starts)),
  s -> s.starts)
"""


def _grouped(entries: DataFrame, keys: list[str], order: str, text: Column, flush: str, name: str) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(text).alias("len"), top_section(F.col("msgctxt")).alias("section"), F.col("msgctxt").alias("ctx"))))
    folded = entries.groupBy(*keys).agg(items.alias("items")).withColumn("starts", F.expr(_FOLD.format(flush=flush)))
    groups = folded.select(*keys, "items", "starts", F.posexplode("starts").alias("no", "begin"))
    end = F.coalesce(F.try_element_at("starts", F.col("no") + 2), F.size("items"))
    rows = groups.select(*keys, "no", F.explode(F.slice("items", F.col("begin") + 1, end - F.col("begin"))).alias("x"))
    return rows.select(*keys, F.col("x.ctx").alias("msgctxt"), F.col("x.len").alias("chars"), F.col("no").alias(name))


def section_groups(entries: DataFrame, size: int = BATCH_SIZE, chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, msgctxt, chars, group_no): entries in order; a group ends when it is full or long enough, or when the
    top-level section changes and it holds at least half its size. An entry beyond the limit is a group of its own."""
    full = f"(s.n + 1 > {size} OR s.chars + x.len > {chars} OR (s.section <> x.section AND s.n >= {max(1, size // 2)}))"
    return _grouped(entries, ["doc_id"], "ord", F.col("msgid"), full, "group_no")


def chunks(entries: DataFrame, keys: list[str], size: int = BATCH_SIZE, chars: int = BATCH_CHARS) -> DataFrame:
    """(keys, msgctxt, chars, chunk_no): the same without sections, inside each key."""
    full = f"(s.n + 1 > {size} OR s.chars + x.len > {chars})"
    return _grouped(entries, keys, "ord", F.col("msgid"), full, "chunk_no")


def estimate(pending: DataFrame, size: int = BATCH_SIZE, chars: int = BATCH_CHARS) -> DataFrame:
    """Pending entries, characters, batches and tokens of each document, without a call to a model."""
    groups = section_groups(pending, size, chars)
    out = groups.groupBy("doc_id").agg(F.count("*").alias("pending"), F.sum("chars").alias("chars"), (F.max("group_no") + 1).cast("long").alias("batches"))
    tokens = F.greatest(F.lit(1), F.expr("chars div 4")).cast("long")
    return out.withColumn("input_tokens", tokens).withColumn("output_tokens", F.floor(tokens * 12 / F.lit(10)).cast("long"))


def section_cuts(texts: list[str], sections: list[str], size: int = BATCH_SIZE, chars: int = BATCH_CHARS) -> list[tuple[int, int]]:
    """The groups of section_groups() for one document inside a worker, as ranges of places."""
    starts, n, held = [], 0, 0
    for i, (text, section) in enumerate(zip(texts, sections)):
        if not starts or n + 1 > size or held + len(text) > chars or (section != sections[i - 1] and n >= max(1, size // 2)):
            starts.append(i)
            n = held = 0
        n, held = n + 1, held + len(text)
    return list(zip(starts, [*starts[1:], len(texts)]))


def chunk_cuts(texts: list[str], size: int = BATCH_SIZE, chars: int = BATCH_CHARS) -> list[tuple[int, int]]:
    """The same without sections: what one call takes, by its encoded texts."""
    return section_cuts(texts, [""] * len(texts), size, chars)
