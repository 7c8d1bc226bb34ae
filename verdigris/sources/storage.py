"""Results that must not be computed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Written once to the folder that the session names in spark.checkpoint.dir, and read from there ever after.

    A translator's answers cost money and may differ between calls, so neither a second use nor a lost executor may ask
    again for what is there. Where the setting is missing, a temporary folder serves if all runs in one process; on a
    cluster that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="verdigris-"))
    return df.checkpoint(eager=True)
