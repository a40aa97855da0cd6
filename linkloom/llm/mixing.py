"""Operator 8, mixing sources to target weights by hash-threshold histograms.

Each document's identifier hashes to 60 bits.  Words are summed by source and
leading hash bits, the bucket in which a source's budget ends is found from the
running sum, and only that boundary bucket is summed again by the next bits,
until one hash is left.  A document is in the mix when its hash lies below its
source's threshold, so nothing is sorted and thresholds of growing budgets nest.

Budgets: all words times the source's share of the weights, but at most
``most`` times the source's own words; what is above goes to the other sources
by weight until none is above.  A source whose budget is a multiple of its words
is taken whole that many times and the rest by threshold.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; rows with the same identifier have the same hash and are decided
together; a source without words has target 0; empty tables give empty results;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
HASH_BITS, LEVEL_BITS = 60, 12


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash60(key: Column) -> Column:
    """The first 15 hex digits of the identifier's MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based rank of ``key`` (unique) over the whole table: ranged partitions,
    then offsets from a table with one row per partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").count()
    before = sizes.select("_part", F.sum("count").over(Window.orderBy("_part")).alias("_to"), F.col("count").alias("_own"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return (placed.withColumn(out, within).join(F.broadcast(before), "_part")
            .withColumn(out, F.col(out) + F.col("_to") - F.col("_own")).drop("_part", "_to", "_own"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """(skey, source_size, target) from rows (skey, size)."""
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    kinds = F.array(*[F.lit(w) for w in weights])
    per = cut(ranked(per, "skey", "rank").withColumn(
        "weight", F.element_at(kinds, (F.col("rank") % len(weights) + 1).cast("int"))))
    level, total, cap = None, None, F.col("source_size") * most
    while True:  # each round caps more sources; it ends when none is added
        above = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        full, rest, everything = per.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.sum("source_size")).first()
        total = everything or 0
        if not total or not rest:
            level = level or 0.0
            break
        new = (total - (full or 0)) / rest
        if new == level:
            break
        level = new
    return per.select("skey", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(skey, whole, below): documents are taken ``whole`` times, and once more where hash < below."""
    state = cut(budgets.select(
        "skey",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
        F.lit(0).cast("long").alias("prefix"), F.col("source_size"), F.col("target"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).drop("source_size", "target"))
    done, shift = [], HASH_BITS
    while True:
        shift -= LEVEL_BITS
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")
        hist = (sizes.join(state, "skey").filter(inside)
                .groupBy("skey", "whole", "left", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        run = Window.partitionBy("skey").orderBy("bucket")
        hist = hist.withColumn("before", F.sum("words").over(run) - F.col("words"))
        # the bucket in which the budget ends; a budget that covers all buckets ends in none
        edge = cut(hist.filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))))
        one = (F.col("lo") == F.col("hi")) | F.lit(shift == 0)
        rest = F.col("left") - F.col("before")
        done.append(edge.filter(one).select("skey", F.when(F.col("words") <= 2 * rest, F.col("hi") + 1).otherwise(F.col("lo")).alias("below")))
        state = edge.filter(~one).select("skey", "whole", F.col("bucket").alias("prefix"), rest.alias("left"))
        if shift == 0 or state.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # no edge: the rest of the budget is nothing (whole multiple) or the source has no words
    return budgets.select("skey", "source_size", "target", whole.alias("whole")).join(found, "skey", "left").withColumn(
        "below", F.coalesce("below", F.lit(0).cast("long")))


def source_key(source: Column) -> Column:
    """Text order with null last: a leading 0 or 1 before the source's own bytes."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most: int) -> tuple[DataFrame, DataFrame]:
    """(sizes: doc_id, source, skey, size, h; plan: skey, source_size, target, whole, below)."""
    source = F.col(source_col).cast("string")
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), source_key(source).alias("skey"),
                            n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")))
    return sizes, cut(thresholds(sizes, cut(targets(sizes, weights, most))))


def repeats(h: Column) -> Column:
    return (F.col("whole") + F.when(h < F.col("below"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, most: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken."""
    sizes, plan = planned(docs, id_col, text_col, source_col, weights, most)
    return sizes.join(plan, "skey").withColumn("repeats", repeats(F.col("h"))).select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights=WEIGHTS, most: int = 3) -> DataFrame:
    """The mix itself: the input's rows and columns, each row as often as it is taken."""
    _, plan = planned(docs, id_col, text_col, source_col, weights, most)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), hash60(F.col(id_col)).alias("h"),
                       source_key(F.col(source_col).cast("string")).alias("skey"))
    return rows.join(plan, "skey").select(F.explode(F.array_repeat("row", repeats(F.col("h")).cast("int"))).alias("row")).select("row.*")
