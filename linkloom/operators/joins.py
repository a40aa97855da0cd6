"""Joins of a large table with a per-site (or per-cluster) side table.

Joining on ``site`` alone sends every row of a site to one task, and one site
may hold a third of the data.  The small side is written once, its rows are
measured in bytes, and it is broadcast within a bound; beyond the bound it is
replicated over ``salts`` buckets and the large side is spread by a hash of
its row key, so no single task gets a whole site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut

MAX_BROADCAST_BYTES = 32 << 20


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a written table's rows in memory: its values as text, plus 16 per value."""
    width = F.octet_length(F.to_json(F.struct(*df.columns))) + F.lit(16 * len(df.columns))
    return int(df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])


def join_side_table(big: DataFrame, small: DataFrame, on: list, how: str = "inner", spread_key: str = "url",
                    max_bytes: int = MAX_BROADCAST_BYTES, salts: int = 64) -> DataFrame:
    """Join ``big`` with a side table keyed by ``on``; broadcast when it is small."""
    small = cut(small)
    return site_join(big, small, stored_bytes(small), how, spread_key, max_bytes, salts, on)


def site_join(big: DataFrame, small: DataFrame, n_bytes: int, how: str = "inner", spread_key: str = "url",
              max_bytes: int = MAX_BROADCAST_BYTES, salts: int = 64, on: tuple = ("site",)) -> DataFrame:
    """Join with a side table whose size the caller has already measured: broadcast
    within the bound, salted beyond it.  Used inside loops, where a measurement
    per round would cost a job."""
    if n_bytes <= max_bytes:
        return big.join(F.broadcast(small), list(on), how)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_key)), F.lit(salts)).cast("int"))
    return salted_big.join(salted_small, [*on, "_salt"], how).drop("_salt")
