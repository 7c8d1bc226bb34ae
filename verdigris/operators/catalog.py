"""The translation catalog as a table: sync, states, commits, carry-over.

Columns: doc_id, ord, msgctxt, msgid, msgstr (empty: untranslated), fuzzy, obsolete, and tcomment, which says why an
entry failed; a table without tcomment has none. Keys are (doc_id, msgctxt). Null texts count as they are, empty tables
give empty results, and of rows that repeat a key each is matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_type, trimmed

SKIP_TYPES = ("hr",)
COLUMNS = ["doc_id", "ord", "msgctxt", "msgid", "msgstr", "fuzzy", "obsolete"]
CATALOG = "doc_id long, ord int, msgctxt string, msgid string, msgstr string, fuzzy boolean, obsolete boolean"

#: What ends a line for str.splitlines, and so in the line numbers of text_blocks.
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def translatable(msgctxt: Column) -> Column:
    """Whether an entry is of no skipped type; one without a context id is of none, nor one that ends in another type's number."""
    other = msgctxt.rlike(rf"::(?!(?:{'|'.join(SKIP_TYPES)}):)[a-z]+:[0-9]+$")
    return F.coalesce(~block_type(msgctxt).isin(*SKIP_TYPES) | other, F.lit(True))


def commented(catalog: DataFrame) -> DataFrame:
    return catalog if "tcomment" in catalog.columns else catalog.withColumn("tcomment", F.lit(None).cast("string"))


def sync(blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog after the blocks' current text: one full outer join on (doc_id, msgctxt).

    Changed text keeps its translation and turns fuzzy (skipped types never do), new blocks join untranslated at the
    end, and entries without a block are dropped. state tells which happened: kept, changed, new or dropped.
    """
    # Whether a side matched is a column of its own, so that text may be null on either side.
    left = blocks.select("doc_id", "msgctxt", F.col("text").alias("new_text"), "seq", F.lit(True).alias("here"))
    right = commented(catalog).where("NOT obsolete").select(*COLUMNS[:-1], "tcomment", F.lit(True).alias("known"))
    both = left.join(right, ["doc_id", "msgctxt"], "full_outer")
    differs = ~F.col("new_text").eqNullSafe(F.col("msgid"))
    state = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "dropped").when(differs & translatable(F.col("msgctxt")), "changed").otherwise("kept")
    return both.select(
        "doc_id",
        F.coalesce("ord", F.lit(1_000_000_000) + F.col("seq")).alias("ord"),
        "msgctxt",
        F.when(F.col("here"), F.col("new_text")).otherwise(F.col("msgid")).alias("msgid"),
        F.coalesce("msgstr", F.lit("")).alias("msgstr"),
        (F.coalesce("fuzzy", F.lit(False)) | (state == "changed")).alias("fuzzy"),
        (state == "dropped").alias("obsolete"),
        state.alias("state"),
        "tcomment",
    )


def reordered(synced: DataFrame) -> DataFrame:
    """The table to store after sync(): dropped entries gone, ord counted anew in each document."""
    order = Window.partitionBy("doc_id").orderBy("ord", "msgctxt")
    return synced.where("NOT obsolete").withColumn("ord", F.row_number().over(order) - 1).select(*COLUMNS, "tcomment")


def pending(catalog: DataFrame) -> DataFrame:
    """Entries to translate: alive, not of a skipped type, and untranslated or fuzzy."""
    return catalog.where(~F.col("obsolete") & translatable(F.col("msgctxt")) & ((F.col("msgstr") == "") | F.col("fuzzy")))


def unprocessed(catalog: DataFrame) -> DataFrame:
    """Untranslated and not fuzzy; rules count here."""
    return catalog.where("NOT obsolete AND msgstr = '' AND NOT fuzzy")


def fuzzy_entries(catalog: DataFrame) -> DataFrame:
    """Entries marked fuzzy, obsolete ones apart."""
    return catalog.where("NOT obsolete AND fuzzy")


def pool_seed(catalog: DataFrame) -> DataFrame:
    """Pairs that may serve as references, in catalog order."""
    return catalog.where("NOT obsolete AND NOT fuzzy AND msgstr <> ''").select("doc_id", "ord", F.col("msgid").alias("src"), F.col("msgstr").alias("tgt"))


def stats(catalog: DataFrame) -> DataFrame:
    """Entries by state and document; fuzzy counts whether or not there is a translation."""
    return catalog.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.expr("count_if(NOT obsolete AND NOT fuzzy AND msgstr <> '')").alias("processed"),
        F.expr("count_if(NOT obsolete AND fuzzy)").alias("fuzzy"),
        F.expr("count_if(NOT obsolete AND NOT fuzzy AND msgstr = '')").alias("unprocessed"),
        F.expr("count_if(obsolete)").alias("obsolete"),
    )


def coverage(blocks: DataFrame, catalog: DataFrame, *keys: str) -> DataFrame:
    """Blocks, translatable blocks, translated and fuzzy ones, by the given keys of blocks.

    A fuzzy entry counts as fuzzy only if it has a translation. pct is of translatable blocks, 0 when there are none.
    """
    entries = catalog.where("NOT obsolete").select("doc_id", "msgctxt", "msgstr", "fuzzy")
    both = blocks.select("doc_id", "msgctxt", "type").join(entries, ["doc_id", "msgctxt"], "left")
    can = ~F.col("type").isin(*SKIP_TYPES)
    has = can & (F.coalesce("msgstr", F.lit("")) != "")
    out = both.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(can).alias("translatable"),
        F.count_if(has & ~F.col("fuzzy")).alias("translated"),
        F.count_if(has & F.col("fuzzy")).alias("fuzzy"),
    )
    return out.withColumn("pct", F.when(F.col("translatable") > 0, F.round(100.0 * F.col("translated") / F.col("translatable"), 6)).otherwise(0.0))


def rebuilt(blocks: DataFrame, catalog: DataFrame, docs: DataFrame, ends: str = LINE_ENDS) -> DataFrame:
    """(doc_id, text): documents with each translated block in place of its lines; gaps and skipped blocks verbatim.

    A translated block ends in a newline even at the end of the document, as all its lines do. Fuzzy translations are
    used. Null texts stay null. ends are the characters that end a line in the blocks' line numbers.
    """
    entries = catalog.where("NOT obsolete").select("doc_id", "msgctxt", "msgstr")
    new = blocks.join(entries, ["doc_id", "msgctxt"], "left").where(translatable(F.col("msgctxt")) & (F.coalesce("msgstr", F.lit("")) != ""))
    edits = new.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "msgstr"))).alias("edits"))
    joined = docs.select("doc_id", "text").join(edits, "doc_id", "left")
    lines = F.regexp_extract_all("text", F.lit(rf"[^{ends}]*(?:\r\n|[{ends}])|[^{ends}]+"), F.lit(0))
    # Each edit gives the lines before it and its own text; all are put together once.
    out = F.expr(
        """array_join(concat(
             flatten(transform(edits, (e, i) -> array(array_join(slice(ls, IF(i = 0, 0, edits[i - 1].end_line) + 1, e.start_line - IF(i = 0, 0, edits[i - 1].end_line)), ''), e.msgstr || '\n'))),
             array(array_join(slice(ls, edits[size(edits) - 1].end_line + 1, greatest(size(ls) - edits[size(edits) - 1].end_line, 0)), ''))), '')"""
    )
    return joined.withColumn("ls", lines).select("doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(out).alias("text"))


def carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries with the fuzzy flag and comment of the old entry that has the same text: nth occurrence to nth."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "msgid").orderBy("ord"))
    left = commented(new).withColumn("nth", nth)
    right = commented(old).withColumn("nth", nth).select("doc_id", "msgid", "nth", F.col("fuzzy").alias("was_fuzzy"), F.col("tcomment").alias("had"))
    both = left.join(right, ["doc_id", "msgid", "nth"], "left")
    return both.withColumns({"fuzzy": F.col("fuzzy") | F.coalesce("was_fuzzy", F.lit(False)), "tcomment": F.coalesce("had", "tcomment")}).drop("was_fuzzy", "had")


def committed(catalog: DataFrame, answers: DataFrame) -> DataFrame:
    """Catalog with answers (doc_id, msgctxt, answer, failed[, reason]): a failed one is fuzzy and left untranslated.

    Its reason is added to the comment; a later success leaves the comment as it is.
    """
    if "reason" not in answers.columns:
        answers = answers.withColumn("reason", F.lit(None).cast("string"))
    joined = commented(catalog).join(answers.withColumn("answered", F.lit(True)), ["doc_id", "msgctxt"], "left")
    done = F.coalesce("answered", F.lit(False)) & F.col("answer").isNotNull()
    return joined.select(
        "doc_id",
        "ord",
        "msgctxt",
        "msgid",
        F.when(done, F.when(F.col("failed"), "").otherwise(F.col("answer"))).otherwise(F.col("msgstr")).alias("msgstr"),
        F.when(done, F.col("failed")).otherwise(F.col("fuzzy")).alias("fuzzy"),
        "obsolete",
        F.when(done & F.col("failed"), F.nullif(F.concat_ws("\n", F.nullif("tcomment", F.lit("")), "reason"), F.lit(""))).otherwise(F.col("tcomment")).alias("tcomment"),
    )


def redrawn(blocks: DataFrame, before: DataFrame) -> DataFrame:
    """The catalog of a document that its own translation replaced: every block is its own translation.

    Entries that a validator refused keep their flag and comment, by text and occurrence.
    """
    fresh = blocks.select("doc_id", F.col("seq").alias("ord"), "msgctxt", F.col("text").alias("msgid"), F.col("text").alias("msgstr"), F.lit(False).alias("fuzzy"), F.lit(False).alias("obsolete"))
    # A committed entry's text is now the translation, so old entries are found by what stands in the document.
    old = commented(before).where("NOT obsolete").withColumn("msgid", F.when((F.col("msgstr") != "") & translatable(F.col("msgctxt")), F.col("msgstr")).otherwise(F.col("msgid")))
    return carried(old, fresh).select(*COLUMNS, "tcomment")


def file_stats(docs: DataFrame, blocks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lines, blocks, coverage and entry states of each document, from the catalog as it is (nothing is synced)."""
    lines = docs.select("doc_id", F.coalesce(F.size(F.expr(r"regexp_extract_all(text, '[^\n]*\n|[^\n]+$', 0)")), F.lit(0)).alias("total_lines"))
    states = stats(catalog).select("doc_id", *[F.col(c).alias(f"entries_{c}") for c in ("total", "processed", "fuzzy", "unprocessed", "obsolete")])
    return lines.join(coverage(blocks, catalog, "doc_id"), "doc_id", "left").join(states, "doc_id", "left").na.fill(0)


def echoes(pairs: DataFrame) -> DataFrame:
    """Adds is_echo: the answer is the source, code apart; such answers are warned about, not refused."""
    return pairs.withColumn("is_echo", (trimmed(F.col("answer")) == trimmed(F.col("msgid"))) & (block_type(F.col("msgctxt")) != "code"))
