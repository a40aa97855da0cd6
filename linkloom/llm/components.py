"""Connected components of a link table, by alternating large and small stars.

Every round points nodes at the smallest neighbour known; the graph shrinks to
stars whose centres are the smallest nodes.  All rounds are joins and grouped
minima over the links; only a count and a checksum reach the driver, to see that
a round changed nothing.  The links of a hub aren't gathered: its minimum goes to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.hot import hot_join
from linkloom.operators.iterate import cut, discard


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    return hot_join(both, low, ["u"], 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    # rows have u > v; all smaller neighbours of u, and u itself, point at the smallest
    low = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    out = hot_join(links, low, ["u"], total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links in any direction -> (node, label), label = smallest node reachable.
    Nodes without links, and links of a node to itself, don't appear."""
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = cut(links)
    state = _state(links)
    while state[0]:
        large = cut(_large_star(links, state[0]))
        old, links = links, cut(_small_star(large, state[0]))
        discard(old, large)
        new = _state(links)
        if new == state:
            break
        state = new
    centres = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
