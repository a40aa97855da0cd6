"""Structured Streaming form of edge building (D3).

A stream of link rows ``(site, src, href)`` keeps running weights per
(site, source, target) in Spark's state store; each micro-batch's updated
rows are appended to an edge log with the batch id, and the current edge
table is the latest weight per key.  Each log has its own stream checkpoint,
beside it unless given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_updates(links: DataFrame) -> DataFrame:
    """Running weight per (site, source, target) of a (streaming) link table."""
    return links.groupBy("site", F.col("src").alias("source"), F.col("href").alias("target")).agg(
        F.count(F.lit(1)).alias("weight"))


def start_edge_stream(spark: SparkSession, source_dir: str, schema: str, log_dir: str,
                      checkpoint_location: str | None = None, available_now: bool = True):
    """Read link files as they arrive in ``source_dir``; append weight updates to ``log_dir``."""
    ckpt = checkpoint_location or f"{log_dir.rstrip('/')}-checkpoint"
    stream = spark.readStream.schema(schema).parquet(source_dir)

    def append(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").partitionBy("site").parquet(log_dir)

    w = edge_updates(stream).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def current_edges(spark: SparkSession, log_dir: str) -> DataFrame:
    """Latest weight per (site, source, target) from the edge log."""
    log = spark.read.parquet(log_dir)
    return log.groupBy("site", "source", "target").agg(F.max_by("weight", "batch_id").alias("weight"))

