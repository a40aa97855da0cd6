"""Derive the library's input tables from the driver tables.

The driver data has no crawl with links between stored pages, so the graph
operators also run on a *click graph* derived from ``events``: consecutive
clicks (global order by ts, event_id) form an edge user -> next user, weight =
number of such transitions.  Node subsets stand in for the reference's
"crawled" and "article" page sets; they are data rules (value thresholds on
events), so they grow with the data:

* crawled  = users with a purchase of value >= 100
* articles = users with an error event of value >= 100
* dangling = users with an error event of value >= 200 lose their out-edges
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import urls as U
from linkloom.operators.sequence import next_in_order

CLICK_SITE = "clicks"
DOC_SITE = "docs"


def site_of(key: str, name: str):
    """The site of a single-site fixture: ``name`` for every keyed row.

    Real tables carry a site column (e.g. the registered domain); a literal
    would let the optimizer fold every join keyed by site into a condition-less
    (nested-loop) join.  Deriving it from the row key keeps it a column, so
    site-keyed joins plan as they do with many sites.
    """
    return F.when(F.col(key).isNotNull(), F.lit(name))

# The subset rules above.
CRAWLED_RULE = ("purchase", 100.0)
ARTICLE_RULE = ("error", 100.0)
DANGLING_RULE = ("error", 200.0)


# Tables whose rows carry long text; per-row regex work on them is CPU-heavy.
TEXT_TABLES = ("pages", "documents")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin rows over the default parallelism when the scan yields fewer
    splits (a single-row-group file reads as one task).  On a cluster reading
    many files the scan already has enough splits and this is a no-op."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# ------------------------------------------------------------------ pages

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: driver ``pages(page_id, url, html)`` -> (site, url, html); site = registered domain."""
    p = read(spark, sf_dir, "pages")
    return p.select(U.registered_domain(F.col("url")).alias("site"), "url", "html", "page_id")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, title, text, depth) as the reference's page record."""
    p = pages(spark, sf_dir)
    return p.select("site", "url", H.extract_title(F.col("html")).alias("title"),
                    H.extract_text(F.col("html")).alias("text"), F.lit(0).alias("depth"), "html")


# ------------------------------------------------------------------ click graph

def click_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").filter(F.col("event_type") == "click").select("ts", "event_id", "user_id")
    seq = next_in_order(ev, ["ts", "event_id"], "user_id", "next_user")
    return seq.filter(F.col("next_user").isNotNull()).select(
        site_of("user_id", CLICK_SITE).alias("site"), F.col("user_id").alias("src"), F.col("next_user").alias("href"),
        F.col("event_id").alias("pos"),
    )


def click_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return ev.select(site_of("user_id", CLICK_SITE).alias("site"), F.col("user_id").alias("url")).distinct()


def click_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = click_transitions(spark, sf_dir)
    return t.groupBy("site", F.col("src").alias("source"), F.col("href").alias("target")).agg(
        F.count(F.lit(1)).alias("weight")
    )


def users_with(spark: SparkSession, sf_dir: str, rule) -> DataFrame:
    etype, minv = rule
    ev = read(spark, sf_dir, "events")
    return ev.filter((F.col("event_type") == etype) & (F.col("value") >= minv)).select(
        site_of("user_id", CLICK_SITE).alias("site"), F.col("user_id").alias("url")
    ).distinct()


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop = users_with(spark, sf_dir, DANGLING_RULE).withColumnRenamed("url", "source")
    return click_edges(spark, sf_dir).join(drop, ["site", "source"], "left_anti")


# ------------------------------------------------------------------ documents / vectors

def language_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; each language is a site of its own."""
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("site"), F.col("doc_id").alias("url"), "text")


def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one site."""
    d = read(spark, sf_dir, "documents")
    return d.select(site_of("doc_id", DOC_SITE).alias("site"), F.col("doc_id").alias("url"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(site_of("vec_id", DOC_SITE).alias("site"), F.col("vec_id").alias("url"),
                    F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster"))


def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector; cluster = the vector's label."""
    docs = all_docs(spark, sf_dir)
    lab = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("url"), F.col("label").alias("cluster"))
    return docs.join(lab, "url")


def article_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillar corpus: documents with a vector (any language); cluster = label;
    title = first line of the text (documents carry no title)."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), "text")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("url"), F.col("label").alias("cluster"),
                                                  F.col("embedding").cast("array<double>").alias("vec"))
    j = d.join(e, "url")
    return j.select(site_of("url", DOC_SITE).alias("site"), "url", "cluster", "vec", "text",
                    F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))


def report_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node table of the click graph in the exported layout: title = first line
    of the user's document (if any), is_article = article rule, cluster = the
    label of the user's vector (if any)."""
    users = click_nodes(spark, sf_dir)
    art = users_with(spark, sf_dir, ARTICLE_RULE).withColumn("is_article", F.lit(True))
    lab = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("url"), F.col("label").alias("cluster"))
    doc = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("url"), F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"))
    return (users.join(art, ["site", "url"], "left").join(lab, "url", "left").join(doc, "url", "left")
            .select("site", "url", "title", F.coalesce("is_article", F.lit(False)).alias("is_article"), "cluster",
                    F.lit(None).cast("string").alias("cluster_keywords")))


# Crawl seeds for the frontier queries = users with a signup of value >= 300.
SEED_RULE = ("signup", 300.0)

# Fixed value: a run has no pages whose component of its own is larger.
RUN_LIMIT = 0.15

# Suffix rules for the hosts of ``pages``, with a wildcard and exceptions to it.
SUFFIX_RULES = ["com", "net", "org", "example.org", "*.example.net", "!tionsh.example.net", "!ththth.example.net", "// a comment"]

# Fixed value: what the report's search box is asked for.
ANCHOR_PATTERN = "ther[a-z]+"
