"""Continuous re-sync: a stream of changed documents kept in step with the stored catalog (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog as cat
from ..operators.segment import blocks


def resync(spark: SparkSession, changes: DataFrame, catalog_dir: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the catalog's next version after every batch of (doc_id, text) changes.

    Versions are folders v=N below catalog_dir: a batch that is delivered again writes its version again from the one
    before, so nothing counts twice. Documents outside the batch are carried over.
    """

    def step(batch: DataFrame, number: int) -> None:
        before = spark._jvm.org.apache.hadoop.fs.Path(f"{catalog_dir}/v={number - 1}")
        known = before.getFileSystem(spark._jsc.hadoopConfiguration()).exists(before)
        old = spark.read.parquet(f"{catalog_dir}/v={number - 1}") if known else spark.createDataFrame([], cat.CATALOG)
        # Of several changes of a document the latest counts: by version if there is one, else the greatest text.
        latest = F.max_by("text", "version") if "version" in batch.columns else F.max("text")
        docs = batch.groupBy("doc_id").agg(latest.alias("text"))
        mine = old.join(docs.select("doc_id"), "doc_id", "left_semi")
        rest = old.join(docs.select("doc_id"), "doc_id", "left_anti")
        cat.reordered(cat.sync(blocks(docs), mine)).unionByName(cat.commented(rest)).write.mode("overwrite").parquet(f"{catalog_dir}/v={number}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
