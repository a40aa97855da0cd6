"""H9: anchor search by posting lists of character trigrams.

``build`` writes, once per edge table, three Parquet tables under a folder:

* ``rows``: the edges, with an id (hash of site, source, target) and ``part``, a bucket of the id;
* ``postings``: (trigram, edge_id) of every trigram of the lower-cased anchors, partitioned by a
  bucket of the trigram and sorted by it, so a query opens a few folders and, in them, a few row groups;
  a bucket is written by ``salts`` tasks, so that a frequent trigram isn't one task's;
* ``lists``: the number of postings of each trigram.

``search`` gives exactly the edges of ``reports.anchor_search``: runs of letters that any match of the
pattern must hold choose the trigrams, the ``LISTS`` shortest of their lists are intersected by counting,
and the pattern itself is then tested on the candidates.  Two edges of one id can only add candidates.
A pattern without such a run of three characters, or whose shortest list holds most rows, is scanned.

Defined cases: null anchors are empty texts; a trigram without a list means no result; an empty table
gives an empty index; repeated rows are found as often as they stand in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import reports as R

LISTS = 4
SCAN_SHARE = 0.5


def required_runs(pattern: str) -> list:
    """Lower-case ASCII runs that every match of the pattern holds; [] where that isn't plain.

    Read are literal characters, escaped punctuation, classes, groups without alternatives outside them,
    and quantifiers; anything else, as flags, quotes, code points and back references, gives []."""
    runs, run, i = [], "", 0

    def close():
        nonlocal run
        if run:
            runs.append(run.lower())
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "|" or c in ")]}":
            return []
        if c == "\\":
            if i + 1 >= len(pattern):
                return []
            c = pattern[i + 1]
            if c in "dDwWsSbB":
                close()
            elif c.isascii() and not c.isalnum() and c.isprintable():
                run += c
            else:
                return []
            i += 2
        elif c == "(":
            depth, i = 1, i + 1
            if pattern[i:i + 1] == "?" and pattern[i:i + 2] != "?:":
                return []
            close()
            while depth:
                if i >= len(pattern) or pattern[i] in "[\\" or pattern[i:i + 2] == "(?" and pattern[i:i + 3] != "(?:":
                    return []
                depth += (pattern[i] == "(") - (pattern[i] == ")")
                i += 1
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0 or any(x in pattern[i + 1:end] for x in ("[", "\\", "&&")):
                return []
            close()
            i = end + 1
        elif c in "?*+{":
            end = i + 1
            if c == "{":
                end = pattern.find("}", i) + 1
                if not end:
                    return []
            if run:
                last, run = run[-1], run if c == "+" else run[:-1]
                close()
                run = last if c == "+" else ""  # the last copy of a repeated character stands before what follows
            i = end + (pattern[end:end + 1] in ("?", "+") and end < len(pattern))
        elif c in ".^$" or not c.isascii():
            # a quantifier may follow; a run ends here either way
            close()
            i += 1
        else:
            run += c
            i += 1
    close()
    return runs


def trigrams_of(runs: list) -> list:
    return sorted({r[i:i + 3] for r in runs for i in range(len(r) - 2)})


def _trigram_column(text):
    """The distinct trigrams of a text."""
    starts = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _bucket(trigram, buckets: int):
    return F.pmod(F.xxhash64(trigram), F.lit(buckets)).cast("int")


def build(edges: DataFrame, root: str, buckets: int = 256, parts: int = 64, salts: int = 8) -> None:
    """Write the index of ``edges`` (site, source, target, anchors, ...) under ``root``."""
    edge_id = F.xxhash64("site", "source", "target")
    rows = edges.withColumn("edge_id", edge_id).withColumn("part", F.pmod("edge_id", F.lit(parts)).cast("int"))
    rows.limit(0).write.parquet(f"{root}/columns")  # a partitioned table without rows holds no schema
    rows.repartition("part").write.partitionBy("part").parquet(f"{root}/rows")
    spark = edges.sparkSession
    rows = _rows(spark, root)
    text = F.lower(F.coalesce(F.col("anchors"), F.lit("")))
    pairs = rows.select("edge_id", "part", text.alias("t")).select("edge_id", "part", F.explode(_trigram_column(F.col("t"))).alias("trigram"))
    pairs = pairs.withColumn("bucket", _bucket("trigram", buckets))
    dealt = pairs.repartition("bucket", F.pmod("edge_id", F.lit(salts)))
    dealt.sortWithinPartitions("bucket", "trigram").write.partitionBy("bucket").parquet(f"{root}/postings")
    lists = spark.read.schema("trigram string, edge_id long, part int, bucket int").parquet(f"{root}/postings")
    lists.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", _bucket("trigram", buckets)).sortWithinPartitions("trigram").write.parquet(f"{root}/lists")


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{root}/columns").schema).parquet(f"{root}/rows")


class AnchorIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, root: str):
        self.rows = _rows(spark, root)
        self.lists = spark.read.parquet(f"{root}/lists")
        self._spark, self._root = spark, root

    def postings(self, chosen: list) -> DataFrame:
        """The lists of ``chosen`` rows of ``lists``; other buckets' folders aren't opened."""
        held = self._spark.read.schema("trigram string, edge_id long, part int, bucket int").parquet(f"{self._root}/postings")
        return held.filter(F.col("bucket").isin([r.bucket for r in chosen])).filter(F.col("trigram").isin([r.trigram for r in chosen]))

    def choose(self, q: str, regex: bool = True) -> list | None:
        """The shortest lists to read; None: scan; []: nothing can match."""
        runs = required_runs(q) if regex else "".join(c if c.isascii() else "\n" for c in q.lower()).split("\n")
        wanted = trigrams_of(runs)
        if not wanted:
            return None
        held = self.lists.filter(F.col("trigram").isin(wanted)).collect()  # at most one row per trigram of the pattern
        if len(held) < len(wanted):
            return []
        short = sorted(held, key=lambda r: (r.n, r.trigram))[:LISTS]
        return None if short[0].n > SCAN_SHARE * self.rows.count() else short

    def search(self, q: str, regex: bool = True) -> DataFrame:
        """The rows of ``reports.anchor_search(edges, q, regex)``."""
        chosen = self.choose(q, regex)
        rows = self.rows
        if chosen is not None:
            found = self.postings(chosen).groupBy("part", "edge_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(chosen))
            rows = rows.join(found.select("part", "edge_id"), ["part", "edge_id"], "left_semi") if chosen else rows.limit(0)
        return R.anchor_search(rows, q, regex).drop("edge_id", "part")
