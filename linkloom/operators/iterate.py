"""Driver-side loop helpers for iterative operators (PageRank, BFS, frontier).

Every round references the previous one more than once (join + aggregate +
convergence check), so without a cut the logical plan doubles each round.
Each round is therefore persisted (so the write does not recompute it) and
cut with a *reliable* ``checkpoint()`` into ``spark.checkpoint.dir`` — a shared
folder on a cluster — so a lost executor never forces a replay of earlier
rounds.  The round tables are small next to the edge tables (one row per node
or per reached pair), so the write costs about as much as one shuffle.
"""

from __future__ import annotations

import os
import threading
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from linkloom.session import ensure_checkpoint_dir

# "table": write Parquet under spark.checkpoint.dir and read it back (columnar,
# compressed); "rdd": Dataset.checkpoint (keeps the partitioning, row format).
CUT_MODE = os.environ.get("LINKLOOM_CUT", "table")


_held = threading.local()


def _delete(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark):
    """Tables that ``cut`` writes inside are removed at the end, so a loop of batches keeps what it returns and
    no more.  What leaves the scope must be written with ``cut(df, keep=True)``, and nothing lazy may read the others."""
    outer, _held.paths = getattr(_held, "paths", None), []
    try:
        yield
    finally:
        mine, _held.paths = _held.paths, outer
        for path in mine:
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that a later round replaces; nothing lazy may still read them."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Materialize ``df`` once in the shared checkpoint folder and return a
    plan-free copy that survives executor loss.  ``keep``: the table outlives the current ``scope``."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    if CUT_MODE == "table":
        path = f"{root}/tables/{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        if not keep and getattr(_held, "paths", None) is not None:
            _held.paths.append(path)
        out = spark.read.parquet(path)
        out._cut_path = path
        return out
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def partitions_for(spark, rows: int, rows_per_partition: int = 250_000) -> int:
    """Partition count for a table of ``rows`` rows: about ``rows_per_partition``
    rows each, whatever their number — small loop tables do not pay for hundreds
    of near-empty tasks every round, large ones get as many tasks as they need."""
    return max(1, -(-rows // rows_per_partition))


def cut_by(df: DataFrame, parts: int, keys: list) -> DataFrame:
    """Like ``cut``, hash-partitioned by ``keys``: a reliable ``checkpoint()`` keeps the
    partitioning, so later joins and groupings on the keys need no exchange."""
    ensure_checkpoint_dir(df.sparkSession)
    held = df.repartition(parts, *keys).persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out

