"""Operator 10, exact dedup by content sort.  DataFrame functions only.

Sampled splitters range-partition the normalised texts (A-Z lower-cased, nothing
else), each partition is sorted on disk where it must be, and a window over the
sorted run compares each text in full with its neighbour: equal texts are
adjacent, and the row with the largest identifier of each run stays.

A text that fills a good part of a partition (found by counting a sample chosen
by identifier hash) gets a slice number as second sort key, so its run spreads
over several partitions; the few sliced runs are then summed up by digest.  At
most ``2 * partitions`` texts can be that frequent, which bounds the broadcast.

Defined cases: a null text counts as empty, and all empty texts are copies of one
another; a null identifier is smaller than any other; of rows equal in text and
identifier one stays; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut

SAMPLE_PER_PARTITION = 40
LEAD_CHARS = 32


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the same and faster where a text is all ASCII."""
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(by_letter)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and with
    ``carry`` the input row as struct ``row``."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    riding = ["row"] if carry else []
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    sha = F.unhex(F.sha2(ascii_lower(F.col("text")), 256))

    stride = max(1, rows // (SAMPLE_PER_PARTITION * n))
    share = max(1.0, rows / n)
    hot = cut(
        texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(stride)) == 0)
        .groupBy(sha.alias("sha")).agg((F.count(F.lit(1)) * stride).alias("about"))
        .filter((F.col("about") >= share / 2) & (F.col("about") >= 5 * stride))
        .select("sha", F.ceil(F.col("about") * 4 / share).cast("int").alias("slices")))

    marked = texts.withColumn("sha", sha).join(F.broadcast(hot), "sha", "left")
    slice_no = F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.coalesce("slices", F.lit(1)))
    # Splitters are rows of the sort key, so the key leads with a bounded part of the text
    # and its digest: what the driver samples doesn't grow with the length of texts.
    ranged = (marked.select("doc_id", *(["row"] if carry else ["text"]), "sha", ascii_lower(F.left("text", F.lit(LEAD_CHARS))).alias("lead"),
                            F.col("slices").isNotNull().alias("sliced"), slice_no.alias("slice"))
              .repartitionByRange(n, "lead", "sha", "slice"))
    whole_text = F.coalesce(F.col("row").getField(text_col), F.lit("")) if carry else F.col("text")
    ranged = ranged.withColumn("norm", ascii_lower(whole_text))
    run = Window.partitionBy("lead", "sha", "slice", "norm")
    runs = cut(ranged.select(
        "doc_id", *riding, "sha", "sliced",
        F.max("doc_id").over(run).alias("run_id"), F.count(F.lit(1)).over(run).alias("run_size"),
        F.row_number().over(run.orderBy(F.desc_nulls_last("doc_id"))).alias("place")))

    whole = runs.filter("sliced").groupBy("sha").agg(F.max("doc_id").alias("all_id"), F.count(F.lit(1)).alias("all_size"))
    keep_id = F.when(F.col("sliced"), F.col("all_id")).otherwise(F.col("run_id"))
    return (
        runs.join(F.broadcast(whole), "sha", "left")
        .select(*riding, "doc_id", keep_id.alias("keep_id"), F.coalesce("all_size", "run_size").alias("group_size"),
                (F.col("doc_id").eqNullSafe(keep_id) & (F.col("place") == 1)).alias("kept"),
                F.lower(F.hex("sha")).alias("text_sha256")))
