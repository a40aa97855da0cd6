"""Page sources (A1): raw (url, html) rows or a crawl dump (map url -> page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import urls as U
from linkloom.operators import graph as G

PAGE_STRUCT = ("struct<url:string,title:string,text:string,"
               "links:array<struct<href:string,anchor:string>>,depth:int>")


def read_crawl_dump(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """A crawl dump is one JSON object {url: page}; each file is read whole
    (one task per file — the format has no row boundaries; our own format is
    Parquet).  -> (site, url, title, text, links, depth)."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.explode(F.from_json("value", f"map<string,{PAGE_STRUCT}>")).alias("url", "p"))
    s = F.lit(site) if site else U.registered_domain(F.col("url"))
    return one_per_url(m.select(s.alias("site"), "url", "p.title", "p.text", "p.links", "p.depth"))


def one_per_url(pages: DataFrame) -> DataFrame:
    """The page table's key is (site, url): of several rows the one of least depth
    stays, then the longest, then the first in text order."""
    body = "html" if "html" in pages.columns else "text"
    rank = F.struct(F.coalesce("depth", F.lit(0)), -F.length(F.coalesce(body, F.lit(""))), F.coalesce(body, F.lit("")))
    others = [c for c in pages.columns if c not in ("site", "url")]
    return pages.groupBy("site", "url").agg(F.min_by(F.struct(*others), rank).alias("p")).select("site", "url", "p.*")


def pages_from_html(df: DataFrame, site_col: str | None = None, domains: DataFrame | None = None) -> DataFrame:
    """(url, html[, depth]) -> page records with title, text and internal,
    resolved links (B1-B5, B9)."""
    site = F.col(site_col) if site_col else U.registered_domain(F.col("url"))
    depth = F.col("depth").cast("int") if "depth" in df.columns else F.lit(0)
    pages = one_per_url(df.select(site.alias("site"), "url", "html", depth.alias("depth")))
    links = G.keep_internal(G.resolve_links(G.page_links(pages)), domains)
    per_page = links.groupBy("site", F.col("src").alias("url")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "href", "anchor"))),
                    lambda s: F.struct(s["href"].alias("href"), s["anchor"].alias("anchor"))).alias("links"))
    base = pages.select("site", "url", H.extract_title(F.col("html")).alias("title"),
                        H.extract_text(F.col("html")).alias("text"), "depth")
    return base.join(per_page, ["site", "url"], "left").withColumn(
        "links", F.coalesce("links", F.array().cast("array<struct<href:string,anchor:string>>")))


def links_of(pages: DataFrame) -> DataFrame:
    """Page records -> links(site, src, pos, href, anchor)."""
    return pages.select("site", F.col("url").alias("src"), F.posexplode("links").alias("pos", "l")).select(
        "site", "src", (F.col("pos") + 1).cast("int").alias("pos"), F.col("l.href").alias("href"),
        F.col("l.anchor").alias("anchor"))
