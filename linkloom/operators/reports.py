"""Report queries over the exported tables.

Inputs follow the exported layouts: ``nodes(site, url, title, is_article,
cluster, cluster_keywords)``, ``edges(site, source, target, weight, anchors)``,
``centrality(site, url, pagerank, ...)``, ``recs(site, source_url, target_url,
similarity)``, ``layout(site, url, x, y, cluster)``.

Whole-table statistics (min/max for scaling) are per-site aggregates joined
back as side tables, never windows over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.graph import anchor_string, induced_edges
from linkloom.operators.joins import join_side_table

# The dashboard's 20-colour cluster palette and the colour of
# nodes without a cluster.
PALETTE = [
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf",
    "#393b79", "#637939", "#8c6d31", "#843c39", "#7b4173", "#3182bd", "#e6550d", "#31a354", "#756bb1", "#636363",
]
NO_CLUSTER_COLOR = "#cccccc"


def overview(nodes: DataFrame, edges: DataFrame, centrality: DataFrame) -> DataFrame:
    """H1-H4: total pages, internal links, article pages, topic clusters per site."""
    n = nodes.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.countDistinct(F.when(F.col("is_article"), F.col("cluster"))).alias("topic_clusters"),
    )
    e = edges.groupBy("site").agg(F.count(F.lit(1)).alias("internal_links"))
    c = centrality.groupBy("site").agg(F.count(F.lit(1)).alias("article_pages"))
    return (n.join(e, "site", "full").join(c, "site", "full")
            .select("site", *[F.coalesce(x, F.lit(0)).alias(x) for x in
                              ("total_pages", "internal_links", "article_pages", "topic_clusters")]))


def cluster_distribution(nodes: DataFrame) -> DataFrame:
    """H5: per cluster of article nodes: count and its keywords ('' if none)."""
    art = nodes.filter(F.col("is_article") & F.col("cluster").isNotNull())
    return art.groupBy("site", "cluster").agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.min("cluster_keywords"), F.lit("")).alias("keywords"),
    )


def authority_table(centrality: DataFrame, nodes: DataFrame, top: int = 25) -> DataFrame:
    """H6: centrality left-joined with node attributes, top ``top`` by pagerank per site."""
    j = centrality.join(nodes, ["site", "url"], "left")
    w = Window.partitionBy("site").orderBy(F.desc("pagerank"), F.asc("url"))
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """H7: the first ``n`` rows per site in ``order`` (a top-k report)."""
    w = Window.partitionBy("site").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def priority_band(sim):
    """H8: >0.7 high, 0.5-0.7 medium, <0.5 low."""
    s = F.col(sim) if isinstance(sim, str) else sim
    return F.when(s > 0.7, F.lit("high")).when(s >= 0.5, F.lit("medium")).otherwise(F.lit("low"))


def priority_bands(recs: DataFrame) -> DataFrame:
    return recs.groupBy("site", priority_band("similarity").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def anchor_search(edges: DataFrame, q: str, regex: bool = True) -> DataFrame:
    """H9: edges whose anchor string contains ``q`` (case-insensitive; a regex by
    default, as the dashboard's search; ``regex=False`` for a literal)."""
    a = F.coalesce(F.col("anchors"), F.lit(""))
    cond = a.rlike("(?i)" + q) if regex else F.lower(a).contains(q.lower())
    return edges.filter(cond)


def filter_graph(nodes: DataFrame, edges: DataFrame, article_only: bool = True, clusters=None,
                 min_weight: float = 1.0, hide_cross: bool = False):
    """Node filter, induced edges, weight threshold (null -> 1), and
    optionally only edges inside one cluster -> (nodes, edges)."""
    nf = nodes
    if article_only:
        nf = nf.filter(F.col("is_article"))
    if clusters:
        nf = nf.filter(F.col("cluster").isin(list(clusters)))
    ef = induced_edges(edges, nf).filter(F.coalesce(F.col("weight"), F.lit(1)).cast("double") >= float(min_weight))
    if hide_cross:
        cs = nf.select("site", F.col("url").alias("source"), F.col("cluster").alias("cs"))
        ct = nf.select("site", F.col("url").alias("target"), F.col("cluster").alias("ct"))
        ef = ef.join(cs, ["site", "source"]).join(ct, ["site", "target"]).filter(F.col("cs") == F.col("ct")).drop("cs", "ct")
    return nf, ef


def weight_bound(edges: DataFrame) -> DataFrame:
    """The upper end of the strength filter per site, missing weights counting as 1."""
    return edges.groupBy("site").agg(F.max(F.coalesce("weight", F.lit(1))).alias("max_weight"))


def node_style(nodes: DataFrame, centrality: DataFrame) -> DataFrame:
    """size = 15 + 25 * minmax(pagerank) (null -> 0, flat range -> denominator 1);
    colour = palette[cluster mod 20], no cluster -> grey."""
    j = nodes.join(centrality.select("site", "url", "pagerank"), ["site", "url"], "left").withColumn(
        "pr", F.coalesce("pagerank", F.lit(0.0)))
    rng = j.groupBy("site").agg(F.min("pr").alias("lo"), F.max("pr").alias("hi"))
    j = join_side_table(j, rng, ["site"])
    den = F.when((F.col("hi") - F.col("lo")) > 1e-12, F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    pal = F.array(*[F.lit(c) for c in PALETTE])
    color = F.when(F.col("cluster").isNull(), F.lit(NO_CLUSTER_COLOR)).otherwise(
        F.element_at(pal, (F.pmod(F.col("cluster"), F.lit(len(PALETTE))) + 1).cast("int")))
    return j.select("site", "url", (F.lit(15.0) + F.lit(25.0) * (F.col("pr") - F.col("lo")) / den).alias("size"),
                    color.alias("color"))


def pixel_layout(layout: DataFrame, extent: float = 900.0) -> DataFrame:
    """Centre both axes, scale by extent / max(range) (+1e-6), flip y."""
    rng = layout.groupBy("site").agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                     F.min("y").alias("y0"), F.max("y").alias("y1"))
    j = join_side_table(layout, rng, ["site"])
    rx = F.col("x1") - F.col("x0") + F.lit(1e-6)
    ry = F.col("y1") - F.col("y0") + F.lit(1e-6)
    sc = F.lit(extent) / F.greatest(rx, ry)
    return j.select("site", "url", "cluster",
                    ((F.col("x") - (F.col("x0") + rx / 2.0)) * sc).alias("px"),
                    (-(F.col("y") - (F.col("y0") + ry / 2.0)) * sc).alias("py"))


def cluster_centers(pixels: DataFrame, nodes: DataFrame, cluster_kw: DataFrame | None = None) -> DataFrame:
    """Mean pixel position per cluster; label = cluster keywords, else the
    first (lowest url) node's label."""
    c = pixels.groupBy("site", "cluster").agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    first_label = nodes.filter(F.col("cluster_keywords").isNotNull()).groupBy("site", "cluster").agg(
        F.min_by("cluster_keywords", "url").alias("node_label"))
    c = c.join(first_label, ["site", "cluster"], "left")
    if cluster_kw is not None:
        c = c.join(cluster_kw.select("site", "cluster", F.col("keywords").alias("kw")), ["site", "cluster"], "left")
    else:
        c = c.withColumn("kw", F.lit(None).cast("string"))
    return c.select("site", "cluster", "cx", "cy", F.coalesce("kw", "node_label", F.lit("")).alias("label"))


def node_label(title, url, width: int = 40):
    """Title cut to ``width`` chars + '…', else the url."""
    t = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    u = F.col(url) if isinstance(url, str) else url
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).when(
        t != "", t).otherwise(u.cast("string"))


def node_tooltip(nodes: DataFrame) -> DataFrame:
    """Tooltip parts joined by <br/>; missing parts are skipped."""
    t = F.when(F.coalesce(F.col("title"), F.lit("")) != "", F.concat(F.lit("<b>Title</b>: "), F.col("title")))
    c = F.when(F.col("cluster").isNotNull(), F.concat(F.lit("<b>Cluster</b>: "), F.col("cluster").cast("string")))
    s = F.when(F.col("pillar_sim").isNotNull(), F.concat(F.lit("<b>Pillar sim</b>: "), F.format_number(F.col("pillar_sim"), 3)))
    tip = F.concat_ws("<br/>", t, c, s)
    return nodes.select("site", "url", node_label("title", "url").alias("label"),
                        F.when(tip == "", F.col("url").cast("string")).otherwise(tip).alias("tooltip"))


def edge_tooltip(edges: DataFrame) -> DataFrame:
    """First 20 sorted distinct non-empty anchors joined by <br/>."""
    return edges.select("site", "source", "target",
                        anchor_string(F.col("anchors"), limit=1 << 30, sep="<br/>", take=20).alias("tooltip"))


def low_degree(centrality: DataFrame, max_in: float = 0.0, max_out: float | None = None) -> DataFrame:
    """Orphan / low-degree pages."""
    cond = F.col("in_degree") <= max_in
    if max_out is not None:
        cond = cond | (F.col("out_degree") <= max_out)
    return centrality.filter(cond)


def low_relevance(nodes: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` articles least similar to their cluster (pillar_sim)."""
    return head(nodes.filter(F.col("pillar_sim").isNotNull()), [F.asc("pillar_sim"), F.asc("url")], n)


def cluster_link_share(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links inside one cluster vs across clusters (endpoints with a cluster)."""
    cs = nodes.select("site", F.col("url").alias("source"), F.col("cluster").alias("cs"))
    ct = nodes.select("site", F.col("url").alias("target"), F.col("cluster").alias("ct"))
    j = edges.join(cs, ["site", "source"]).join(ct, ["site", "target"]).filter(
        F.col("cs").isNotNull() & F.col("ct").isNotNull())
    within = F.sum(F.when(F.col("cs") == F.col("ct"), 1).otherwise(0))
    return j.groupBy("site").agg(within.cast("bigint").alias("within_links"),
                                 F.count(F.lit(1)).alias("total_links")).withColumn(
        "cross_links", F.col("total_links") - F.col("within_links")).withColumn(
        "within_share", F.col("within_links") / F.col("total_links"))


def snapshot_diff(a: DataFrame, b: DataFrame, key: list, value: str) -> DataFrame:
    """Full outer join of two snapshots of ``value`` keyed by ``key``."""
    return (a.select(*key, F.col(value).alias(f"{value}_a"))
            .join(b.select(*key, F.col(value).alias(f"{value}_b")), key, "full")
            .withColumn("delta", F.coalesce(F.col(f"{value}_b"), F.lit(0.0)) - F.coalesce(F.col(f"{value}_a"), F.lit(0.0))))
