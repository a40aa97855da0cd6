"""Pillar page per cluster.

Candidates are members with enough words that are not listing pages; a
cluster where nobody qualifies falls back to all its members.  The pillar is
the arg-max of (total_sim, pagerank, url, title), where
total_sim = 0.6 * semantic_sim + 0.4 * tfidf_sim.  Both arg-maxes (over
qualifying members and over all members) are ``max`` of a struct per cluster
in one partial aggregate, so a huge cluster is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import urls as U

W_SEMANTIC = 0.6
W_TFIDF = 0.4
MIN_WORDS = 150
EXCERPT_CHARS = 500


def blended(sem, tfidf, w_sem: float = W_SEMANTIC, w_tfidf: float = W_TFIDF):
    """Weighted blend of the two similarities."""
    return F.lit(w_sem) * sem + F.lit(w_tfidf) * tfidf


def pillars(members: DataFrame, semantic: DataFrame, tfidf_sim: DataFrame, pagerank: DataFrame,
            cluster_kw: DataFrame | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """members(site, url, cluster, title, text); semantic / tfidf_sim (site, url, sim);
    pagerank(site, url, pagerank); cluster_kw(site, cluster, keywords ARRAY<STRING>)
    -> one row per (site, cluster): cluster, url, title, pagerank, semantic_sim,
    tfidf_sim, total_sim (4 decimals), cluster_keywords, excerpt."""
    body = H.text_or_title(F.col("text"), F.col("title"))
    m = (
        members.select("site", "url", "cluster", "title", "text")
        .join(semantic.select("site", "url", F.col("sim").alias("sem")), ["site", "url"], "left")
        .join(tfidf_sim.select("site", "url", F.col("sim").alias("tfs")), ["site", "url"], "left")
        .join(pagerank.select("site", "url", "pagerank"), ["site", "url"], "left")
        .select(
            "site", "url", "cluster", "title",
            F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"),
            F.coalesce("sem", F.lit(0.0)).alias("sem"),
            F.coalesce("tfs", F.lit(0.0)).alias("tfs"),
            ((H.word_count(F.coalesce(F.col("text"), F.lit(""))) >= min_words)
             & ~U.is_listing_url(F.col("url").cast("string"))).alias("ok"),
            H.excerpt(F.coalesce(body, F.lit("")), EXCERPT_CHARS).alias("excerpt"),
        )
        .withColumn("total", blended(F.col("sem"), F.col("tfs")))
    )
    # best qualifying member, else best member: two conditional maxima in one
    # partial aggregate (no join back to the members)
    key = F.struct("total", "pagerank", "url", "title", "sem", "tfs", "excerpt")
    best = m.groupBy("site", "cluster").agg(
        F.coalesce(F.max(F.when(F.col("ok"), key)), F.max(key)).alias("b")
    )
    out = best.select(
        "site", "cluster", F.col("b.url").alias("url"), F.col("b.title").alias("title"),
        F.col("b.pagerank").alias("pagerank"), F.round("b.sem", 4).alias("semantic_sim"),
        F.round("b.tfs", 4).alias("tfidf_sim"), F.round("b.total", 4).alias("total_sim"),
        F.col("b.excerpt").alias("excerpt"),
    )
    if cluster_kw is not None:
        kw = cluster_kw.select("site", "cluster", F.array_join("keywords", ", ").alias("cluster_keywords"))
        out = out.join(kw, ["site", "cluster"], "left")
    else:
        out = out.withColumn("cluster_keywords", F.lit(None).cast("string"))
    return out.withColumn("cluster_keywords", F.coalesce("cluster_keywords", F.lit("")))
