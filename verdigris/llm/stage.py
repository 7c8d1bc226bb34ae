"""Session helpers that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share.

    Where none is named, as in tests, a temporary one serves if all runs in one process; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is not None:
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="verdigris-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: what follows doesn't depend on executors that made it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text; rows without a doc_id have no identity and are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def rows_with_id(docs: DataFrame) -> DataFrame:
    """documents' own columns, in order, and nothing else."""
    return docs.select(*[c for c in DOC_COLUMNS if c in docs.columns])
