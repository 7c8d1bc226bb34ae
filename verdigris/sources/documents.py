"""Document scans and writers: a directory tree of text files, one row for a file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(rel_path, doc_id, text) of all files below root; line ends become newlines. doc_id hashes the relative path.

    Files of no bytes have no row: Spark's listing leaves them out.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    base = "file:" + str(Path(root).resolve()) if "://" not in root else root.rstrip("/")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/"))
    rel = F.expr(f"substring({'p'}, length('{base}') + 2)")
    rows = files.select(path.alias("p"), F.regexp_replace("value", "\r\n?", "\n").alias("text")).withColumn("rel_path", rel)
    return rows.select("rel_path", F.xxhash64("rel_path").alias("doc_id"), "text")


def _writer(root: str):
    def run(rows) -> None:
        for r in rows:
            target = (Path(root) / r["rel_path"]).resolve()
            if Path(root).resolve() not in target.parents:
                raise ValueError(f"{r['rel_path']} leads out of {root}")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(r["text"], newline="\n", encoding="utf-8")

    return run


def write(docs: DataFrame, root: str) -> None:
    """Files of (rel_path, text) rows below root, in UTF-8 with newlines; root must be shared by all executors."""
    docs.select("rel_path", "text").where("text IS NOT NULL").foreachPartition(_writer(root))
