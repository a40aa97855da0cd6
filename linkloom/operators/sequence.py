"""Successor-in-global-order without a single-partition window.

``lead(x) over (order by k)`` with no PARTITION BY sorts everything in one
task.  Here the rows are range-partitioned on the order key (balanced by
sampling, so a hot timestamp range is split like any other), the successor is
taken inside each partition with a window keyed by the partition id, and the
last row of each partition is patched with the first row of the next
non-empty partition from a table with one row per partition (bounded by the
partition count, so it is broadcast safely).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut


def next_in_order(df: DataFrame, order_cols: list, value_col: str, out_col: str = "next_value",
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = ``value_col`` of the next row in global ``order_cols`` order.

    ``order_cols`` must form a unique key (ties make "next" ambiguous).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written once: a second range partitioning may sample other bounds
    ranged = cut(df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id()))
    okey = F.struct(*[F.col(c) for c in order_cols])
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    inner = ranged.withColumn(out_col, F.lead(value_col).over(w)).withColumn(
        "_last", F.lead(F.lit(1)).over(w).isNull()
    )
    # first row of every non-empty partition (one row per partition)
    firsts = ranged.groupBy("_pid").agg(F.min_by(F.col(value_col), okey).alias("_first"))
    nxt = firsts.withColumn("_next_first", F.lead("_first").over(Window.orderBy("_pid"))).select("_pid", "_next_first")
    return (
        inner.join(F.broadcast(nxt), "_pid", "left")
        .withColumn(out_col, F.when(F.col("_last"), F.col("_next_first")).otherwise(F.col(out_col)))
        .drop("_pid", "_next_first", "_last")
    )
