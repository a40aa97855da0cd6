"""TF-IDF on a long table.

``docs(site, url, text)`` -> ``tf(site, url, term, tf)`` -> vocabulary per site
(df >= min_df, top ``max_features`` by corpus count, ties by term) ->
``tfidf(site, url, term, tf, df, w)`` with w = tf * (ln((1+n)/(1+df)) + 1),
L2-normalized per document.  Nothing is dense: a document's row is its terms.

Scale notes: documents are shuffled, not their terms, which are counted where
the document is; document frequency is a partial aggregate, so a very common term
does not concentrate work; the vocabulary cut is a per-site top-k window that Spark
limits map-side, and without a cut ranks come from a range partitioning.  For weights,
the documents of a part send a term once, with the numbers of its documents and counts,
and get it back so with its document frequency; a term has as many rows as there are parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators.iterate import cut
from linkloom.operators.joins import join_side_table


def term_counts(docs: DataFrame, stops=None, ngram_max: int = 2) -> DataFrame:
    """(site, url, term, tf) for every term occurrence of every document."""
    # rows of one document come together as texts, so its terms needn't be shuffled
    near = docs.select("site", "url", "text").repartition("site", "url")
    ex = near.select("site", "url", F.explode(T.terms(F.col("text"), stops, ngram_max)).alias("term"))
    return ex.groupBy("site", "url", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("site").agg(F.count(F.lit(1)).alias("n_docs"))


def vocabulary(tf: DataFrame, min_df: int = 2, max_features: int | None = None) -> DataFrame:
    """(site, term, df, cf, rank) — df >= min_df, top max_features by corpus count."""
    stats = tf.groupBy("site", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    stats = stats.filter(F.col("df") >= min_df)
    if max_features is None:
        return _ranked(stats)
    w = Window.partitionBy("site").orderBy(F.desc("cf"), F.asc("term"))
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_features)


def _ranked(stats: DataFrame) -> DataFrame:
    """Ranks of all terms: a site's terms are spread over tasks in order, and counted on from the tasks before."""
    ranged = stats.repartitionByRange(F.asc("site"), F.desc("cf"), F.asc("term")).sortWithinPartitions(F.asc("site"), F.desc("cf"), F.asc("term"))
    ranged = ranged.withColumn("at", F.monotonically_increasing_id())
    ranged = cut(ranged.withColumn("pid", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    before = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("pid")) - F.col("n"))
    numbered = ranged.join(F.broadcast(before), "pid").withColumn("no", F.col("before") + F.col("at"))
    first = numbered.groupBy(F.coalesce("site", F.lit("")).alias("s"), F.col("site").isNull().alias("gone")).agg(F.min("no").alias("lo"))
    numbered = numbered.withColumn("s", F.coalesce("site", F.lit(""))).withColumn("gone", F.col("site").isNull())
    rank = (F.col("no") - F.col("lo") + 1).cast("int").alias("rank")
    return join_side_table(numbered, first, ["s", "gone"], spread_key="term").select("site", "term", "df", "cf", rank)


def tfidf(docs: DataFrame, stops=None, min_df: int = 2, max_features: int | None = None, ngram_max: int = 2,
          tf: DataFrame | None = None) -> DataFrame:
    """(site, url, term, tf, df, w) with smooth idf and L2 row norm."""
    idf = F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0
    norm = F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy("site", "url")))
    out = ["site", "url", "term", "tf", "df", "w"]
    n = doc_counts(docs)
    if tf is not None or max_features is not None:
        tf = term_counts(docs, stops, ngram_max) if tf is None else tf
        voc = vocabulary(tf, min_df, max_features).select("site", "term", "df")
        raw = join_side_table(tf.join(voc, ["site", "term"]), n, ["site"]).withColumn("w0", F.col("tf") * idf)
        return raw.withColumn("w", F.col("w0") / norm).select(*out)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("site", "url"), F.lit(parts)).cast("int").alias("part")
    near = docs.select(part, "site", "url", "text").filter(F.col("site").isNotNull()).repartition(parts, "part")
    ex = near.select("part", "site", "url", F.explode(T.terms(F.col("text"), stops, ngram_max)).alias("term"))
    counts = ex.groupBy("part", "site", "url", "term").agg(F.count(F.lit(1)).alias("tf"))
    lists = counts.groupBy("part", "site", "term").agg(F.collect_list(F.struct("url", "tf")).alias("l"))
    lists = lists.select("part", "site", "term", F.col("l.url").alias("urls"), F.col("l.tf").alias("tfs"))
    df = F.sum(F.size("urls")).over(Window.partitionBy("site", "term"))
    sent = lists.withColumn("df", df).filter(F.col("df") >= min_df).repartition(parts, "part")
    rows = sent.select("part", "site", "term", "df", F.explode(F.arrays_zip("urls", "tfs")).alias("l"))
    rows = rows.select("part", "site", F.col("l.urls").alias("url"), "term", F.col("l.tfs").alias("tf"), "df")
    raw = join_side_table(rows, n, ["site"]).withColumn("w0", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(Window.partitionBy("part", "site", "url")))
    return raw.withColumn("w", F.col("w0") / norm).select(*out)


def doc_keywords(weights: DataFrame, k: int = 20) -> DataFrame:
    """top-k terms per document by weight (tie -> term) ->
    (site, url, keywords ARRAY<STRUCT<term, score>>) in rank order."""
    w = Window.partitionBy("site", "url").orderBy(F.desc(F.round("w", 12)), F.asc("term"))
    top = weights.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    return top.groupBy("site", "url").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "term", "w"))),
                    lambda s: F.struct(s["term"].alias("term"), s["w"].alias("score"))).alias("keywords")
    )


def keyword_string(keywords, sep: str = "; "):
    """K4 format: terms joined by '; '."""
    return F.array_join(F.transform(keywords, lambda s: s["term"]), sep)


def cluster_keywords(doc_kw: DataFrame, labels: DataFrame, k: int = 15) -> DataFrame:
    """F8: per cluster, sum each document's top-k keyword scores by term; top k
    terms (tie -> term) -> (site, cluster, keywords ARRAY<STRING>)."""
    ex = doc_kw.select("site", "url", F.explode("keywords").alias("kw")).select(
        "site", "url", F.col("kw.term").alias("term"), F.col("kw.score").alias("score")
    )
    per = ex.join(labels.select("site", "url", "cluster"), ["site", "url"]).groupBy("site", "cluster", "term").agg(
        F.sum("score").alias("score")
    )
    # rank on the rounded sum: equal sums added in another order stay ties
    w = Window.partitionBy("site", "cluster").orderBy(F.desc(F.round("score", 9)), F.asc("term"))
    top = per.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    return top.groupBy("site", "cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "term"))), lambda s: s["term"]).alias("keywords")
    )


def tfidf_centroids(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """Per cluster, mean of member rows (all members, empty ones included),
    L2-normalized with +1e-9 -> (site, cluster, term, c)."""
    lab = labels.select("site", "url", "cluster")
    members = lab.groupBy("site", "cluster").agg(F.count(F.lit(1)).alias("m"))
    sums = weights.join(lab, ["site", "url"]).groupBy("site", "cluster", "term").agg(F.sum("w").alias("s"))
    mean = sums.join(members, ["site", "cluster"]).withColumn("mu", F.col("s") / F.col("m"))
    nrm = F.sqrt(F.sum(F.col("mu") * F.col("mu")).over(Window.partitionBy("site", "cluster"))) + F.lit(1e-9)
    return mean.withColumn("c", F.col("mu") / nrm).select("site", "cluster", "term", "c")


def centroid_similarity(weights: DataFrame, labels: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """dot(doc, own-cluster centroid); a document without terms gets 0.0 ->
    (site, url, cluster, sim)."""
    lab = labels.select("site", "url", "cluster")
    cen = tfidf_centroids(weights, labels) if centroids is None else centroids
    dots = (
        weights.join(lab, ["site", "url"]).join(cen, ["site", "cluster", "term"])
        .groupBy("site", "url").agg(F.sum(F.col("w") * F.col("c")).alias("sim"))
    )
    return lab.join(dots, ["site", "url"], "left").select(
        "site", "url", "cluster", F.coalesce("sim", F.lit(0.0)).alias("sim")
    )
