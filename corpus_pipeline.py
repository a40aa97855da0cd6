"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before
kept, and returns the rows that stay with the columns of ``documents`` (the last
one: the packed pieces).  Between stages rows are written as Parquet and read
again, so a lost executor costs at most one stage.

Defined cases are those of the operators: null texts and identifiers, empty and
very long texts, ties, repeated rows, empty tables and other columns.  The first
stage keeps rows with null identifiers; of rows equal in text and identifier the
second keeps one; the third decides on each row by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm import content_sort, minhash, mixing, packing, toxicity
from linkloom.llm.queries import remainder, tokenizer_path
from linkloom.operators.iterate import cut
from linkloom.session import table


def columns_of(docs: DataFrame) -> list:
    """Its columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents scored 0.5 or more go.  Labels come from the same rows as in its query."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder() != 0))
    rows = docs.select("doc_id", "text", F.struct(*columns_of(docs)).alias("row"))
    return toxicity.score(rows, model, keep=("row",)).filter("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the row with the largest identifier stays."""
    return content_sort.content_sort(docs, carry=True).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the row with the smallest identifier stays, one of them where it repeats."""
    found = cut(minhash.near_duplicates(docs, sets=True).filter("doc_id IS NOT NULL"))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("stays"))
    plain = docs.join(ids.filter("n > 1 OR NOT stays").select("doc_id"), "doc_id", "left_anti").select(*columns_of(docs))
    # rows that share an identifier are told apart by their sets
    shared = docs.join(ids.filter("n > 1").select("doc_id"), "doc_id", "left_semi").select(*columns_of(docs))
    rows = minhash.with_set_ids(shared).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    own = found.filter("kept AND set_a IS NOT NULL").select("doc_id", *minhash.SET_ID, "group").distinct()
    first = Window.partitionBy("doc_id", "group").orderBy(*minhash.SET_ID, F.col("row.text"), F.hash("row"))
    chosen = rows.join(own, ["doc_id", *minhash.SET_ID]).withColumn("place", F.row_number().over(first)).filter("place = 1")
    return plain.unionByName(rows.filter("set_a IS NULL").select("row.*")).unionByName(chosen.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each row as often as its source's budget takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

# SQL has no tokenizer and learns no lexicon; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
