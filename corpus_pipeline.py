"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A toxic document goes, then one of low quality; of near-duplicates the smallest doc_id stays; passages that several
documents share stay in the first of them only; what is left is packed into training sequences.

Every stage takes any documents table: columns beyond those of documents are dropped, repeated rows are judged each,
and an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.minhash import keep_one
from verdigris.llm.packing import packed
from verdigris.llm.quality import good_documents
from verdigris.llm.stage import rows_with_id, shared_folder, table
from verdigris.llm.suffix_array import without_repeats
from verdigris.llm.toxicity import civil_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the trained machine rejects; null and empty texts stay."""
    return civil_documents(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; null and empty texts score 0 and go."""
    return good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates; wordless texts and rows with a null doc_id stay."""
    return keep_one(rows_with_id(docs))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that an earlier document holds; documents that lose their last word go."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by training sequence; wordless texts and rows with a null doc_id have no piece."""
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("packing", packing),
]

#: Trained models and signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _dropped(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder of the session's checkpoints.

    A stage's folder goes as soon as the next one is written; the last one's is what the result reads.
    """
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _dropped(spark, before)
        before = path
    return docs
