import json

from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators.clustering import choose_k
from linkloom.sources import config as CFG
from linkloom.sources import pages as PG
from linkloom.sources import sitemaps as SM


def test_article_rules_defaults(tmp_path):
    assert CFG.load_article_rules(str(tmp_path / "missing.json")).include == U.DEFAULT_INCLUDE
    p = tmp_path / "cfg.json"
    p.write_text(json.dumps({"article_detection": {"url_patterns": ["/p/"]}, "blog_paths": [
        {"name": "n", "url": "https://a.com/blog", "domain": "a.com", "output_dir": "a_blog", "description": "d"}],
        "crawl_settings": {"max_pages": 7}}))
    r = CFG.load_article_rules(str(p))
    assert r.include == ["/p/"] and r.exclude == U.MISSING_KEY_EXCLUDE
    assert CFG.crawl_limits(str(p)) == {"max_pages": 7, "max_depth": 3}


def test_read_sites(spark, tmp_path):
    p = tmp_path / "cfg.json"
    p.write_text(json.dumps({"blog_paths": [{"name": "n", "url": "u", "domain": "a.com", "output_dir": "a_blog"}]}))
    assert [r.site for r in CFG.read_sites(spark, str(p)).collect()] == ["a_blog"]


def test_crawl_dump_roundtrip(spark, tmp_path):
    dump = {"https://a.com/blog/x": {"url": "https://a.com/blog/x", "title": "X", "text": "t", "depth": 0,
                                     "links": [{"href": "https://a.com/blog/y", "anchor": "why"}]},
            "https://a.com/blog/y": {"url": "https://a.com/blog/y", "title": "Y", "text": "", "depth": 1, "links": []}}
    (tmp_path / "crawl.json").write_text(json.dumps(dump))
    pages = PG.read_crawl_dump(spark, str(tmp_path / "crawl.json"))
    assert {r.url: r.depth for r in pages.collect()} == {"https://a.com/blog/x": 0, "https://a.com/blog/y": 1}
    links = PG.links_of(pages).collect()
    assert [(l.src, l.pos, l.href, l.anchor) for l in links] == [("https://a.com/blog/x", 1, "https://a.com/blog/y", "why")]
    assert {r.site for r in pages.collect()} == {"a.com"}


def test_sitemap_index_cap_and_dedupe(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    docs = [
        ("s", "idx", f"<sitemapindex {ns}><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap>"
                     f"<sitemap><loc>c</loc></sitemap></sitemapindex>"),
        ("s", "a", f"<urlset {ns}><url><loc>https://x.com/1</loc></url><url><loc>https://x.com/2</loc></url>"
                   f"<url><loc>https://other.org/z</loc></url></urlset>"),
        ("s", "b", f"<urlset {ns}><url><loc>https://x.com/2</loc></url><url><loc>https://x.com/3</loc></url></urlset>"),
        ("s", "c", f"<urlset {ns}><url><loc>https://x.com/9</loc></url></urlset>"),
        ("s", "bad", "<html><body>not a sitemap</body></html>"),
    ]
    df = spark.createDataFrame(docs, "site string, sitemap_url string, body string")
    dom = spark.createDataFrame([("s", "x.com")], "site string, domain string")
    out = SM.sitemap_urls(df, dom, max_urls=3)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc, []).append((r.pos, r.url))
    # a: 2 internal urls; b: 2 -> cumulative 2 < 3 so b is taken and crosses the cap; c is not taken
    assert [u for _, u in sorted(got["idx"])] == ["https://x.com/1", "https://x.com/2", "https://x.com/3"]
    assert "bad" not in got


def test_choose_k():
    assert [choose_k(n) for n in (3, 5, 6, 20, 21, 60, 61, 100, 400)] == [1, 1, 2, 2, 3, 3, 7, 10, 20]


def test_read_gzipped_sitemap_files(spark, tmp_path):
    import gzip

    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    (tmp_path / "index.xml").write_text(f"<sitemapindex {ns}><sitemap><loc>posts.xml</loc></sitemap></sitemapindex>")
    with gzip.open(tmp_path / "posts.xml.gz", "wt") as f:
        f.write(f"<urlset {ns}><url><loc>https://x.com/a</loc></url><url><loc>https://x.com/b</loc></url></urlset>")
    docs = SM.read_sitemap_docs(spark, str(tmp_path), site="s")
    out = SM.sitemap_urls(docs, max_urls=10).filter("doc = 'index.xml'").orderBy("pos").collect()
    assert [r.url for r in out] == ["https://x.com/a", "https://x.com/b"]


def test_seeds_sitemap_first_then_seed(spark):
    from linkloom.operators.frontier import seeds_from

    sm = spark.createDataFrame([("s", "https://x.com/b", 1), ("s", "https://x.com/a", 2), ("s", "https://x.com/b", 3)],
                               "site string, url string, pos long")
    seed = spark.createDataFrame([("s", "https://x.com/"), ("s", "https://x.com/a")], "site string, url string")
    got = sorted(seeds_from(sm, seed).collect(), key=lambda r: (r.grp, r.pos))
    assert [r.url for r in got] == ["https://x.com/b", "https://x.com/a", "https://x.com/"]


def test_per_site_fits_with_no_sites(spark):
    from linkloom.operators import clustering as K

    empty = spark.createDataFrame([], "site string, url long, vec array<double>")
    assert K.kmeans(empty).count() == 0 and K.layout_2d(empty).count() == 0
    w = spark.createDataFrame([], "site string, url long, term string, w double")
    v = spark.createDataFrame([], "site string, term string, rank int")
    assert K.term_svd(w, v).count() == 0
