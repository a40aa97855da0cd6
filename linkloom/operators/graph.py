"""Graph construction (D1-D8): pages -> links -> nodes and weighted edges.

Every table carries ``site``; it is part of every grouping / join key so many
sites build in one job.  Node ids live in ``url`` (any orderable type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import urls as U

MAX_ANCHORS = 50
ANCHOR_STRING_CHARS = 2000


def page_links(pages: DataFrame) -> DataFrame:
    """One row per ``<a href>`` -> (site, src, pos, href, anchor)."""
    return pages.select(
        "site", F.col("url").alias("src"), F.explode(H.raw_links(F.col("html"))).alias("l")
    ).select("site", "src", F.col("l.pos").alias("pos"), F.col("l.href").alias("href"), F.col("l.anchor").alias("anchor"))


def resolve_links(links: DataFrame) -> DataFrame:
    """Href -> absolute URL against the source page (fragment cut)."""
    return links.withColumn("raw_href", F.col("href")).withColumn("href", U.resolve_url(F.col("src"), F.col("href")))


def keep_internal(links: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Keep links whose target is internal to the site's domain.

    ``domains(site, domain)`` is one row per site (tiny, broadcast); without it
    the site's domain is the registered domain of the source page.
    """
    if domains is None:
        return links.filter(U.is_internal(F.col("href"), U.registered_domain(F.col("src"))))
    from linkloom.operators.joins import join_side_table

    d = domains.select("site", "domain")
    return join_side_table(links, d, ["site"], spread_key="src").filter(
        U.is_internal(F.col("href"), F.col("domain"))).drop("domain")


def build_nodes(pages: DataFrame, rules: U.ArticleRules | None = None) -> DataFrame:
    """One node per page: title, is_article, depth; late columns nullable."""
    depth = F.col("depth").cast("int") if "depth" in pages.columns else F.lit(None).cast("int")
    title = F.col("title") if "title" in pages.columns else H.extract_title(F.col("html"))
    return pages.select(
        "site",
        "url",
        title.alias("title"),
        U.is_article(F.col("url"), rules).alias("is_article"),
        depth.alias("depth"),
    )


def crawled_links(links: DataFrame, nodes: DataFrame, target_col: str = "href") -> DataFrame:
    """Keep a link only if its target is a crawled page (left-semi join)."""
    keys = nodes.select("site", F.col("url").alias(target_col))
    return links.join(keys, ["site", target_col], "left_semi")


def build_edges(links: DataFrame, src: str = "src", dst: str = "href", max_anchors: int = MAX_ANCHORS,
                with_anchors: bool = True) -> DataFrame:
    """Group links by (site, source, target) in one aggregation.

    weight = number of links (before the anchor cap); anchors = the first
    ``max_anchors`` anchors in document order.  All links of a
    (source, target) group come from one source page, so a group is bounded
    by the size of one page and the per-group list stays small; the count is
    combined map-side.
    """
    keyed = links.select("site", F.col(src).alias("source"), F.col(dst).alias("target"), *(
        [F.col("pos"), F.col("anchor")] if with_anchors else []
    ))
    aggs = [F.count(F.lit(1)).alias("weight")]
    if with_anchors:
        aggs.append(
            F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "anchor"))), lambda s: s["anchor"]),
                    1, max_anchors).alias("anchors")
        )
    return keyed.groupBy("site", "source", "target").agg(*aggs)


def anchor_string(anchors, limit: int = ANCHOR_STRING_CHARS, sep: str = " | ", take: int | None = None):
    """Distinct non-empty anchors, code-point sorted, joined, cut."""
    a = F.array_sort(F.array_distinct(F.filter(anchors, lambda x: x != "")))
    if take is not None:
        a = F.slice(a, 1, take)
    return F.substring(F.array_join(a, sep), 1, limit)


def export_edges(edges: DataFrame) -> DataFrame:
    """K2 layout: source, target, weight, anchors as one string."""
    return edges.select("site", "source", "target", F.coalesce("weight", F.lit(1)).alias("weight"),
                        F.coalesce(anchor_string(F.col("anchors")), F.lit("")).alias("anchors"))


def induced_edges(edges: DataFrame, keep_nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints are both in ``keep_nodes(site, url)``."""
    k = keep_nodes.select("site", "url")
    return (
        edges.join(k.withColumnRenamed("url", "source"), ["site", "source"], "left_semi")
        .join(k.withColumnRenamed("url", "target"), ["site", "target"], "left_semi")
    )


def article_subgraph(nodes: DataFrame, edges: DataFrame):
    """Induced subgraph on ``is_article`` nodes -> (nodes, edges)."""
    art = nodes.filter(F.col("is_article"))
    return art, induced_edges(edges, art)


def attach(nodes: DataFrame, attrs: DataFrame, on=("site", "url")) -> DataFrame:
    """Left join late attributes (cluster, labels, sims); missing -> null."""
    return nodes.join(attrs, list(on), "left")


def default_weight(col="weight"):
    """Missing weight -> 1."""
    return F.coalesce(F.col(col), F.lit(1))
