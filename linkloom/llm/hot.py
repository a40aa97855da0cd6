"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut

FLOOR = 100


def hot_join(rows: DataFrame, side: DataFrame, on: list, total: int, most: int = 100_000, how: str = "inner") -> DataFrame:
    """``rows`` ("inner" or "left") joined with ``side``, which has one row per key and a column ``n``, the number of
    ``rows`` with that key; ``n`` doesn't appear in the result.

    A key with more than ``total / most`` rows is hot.  There are at most about ``most`` of these, whatever the input, so
    their rows of ``side`` are broadcast and their ``rows`` stay where they are; all others are shuffled.  Rows
    whose first key is null match nothing and aren't shuffled."""
    limit = max(FLOOR, total // most)
    hot = cut(side.filter(F.col("n") > limit))
    key = F.col(on[0])
    known, cold = rows.filter(key.isNotNull()), side.filter(F.col("n") <= limit).drop("n")
    if hot.isEmpty():
        out = known.join(cold, on, how)
    else:
        out = known.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how).unionByName(
            known.join(F.broadcast(hot.drop("n")), on))
    if how == "inner":
        return out
    return out.unionByName(rows.filter(key.isNull()), allowMissingColumns=True)
