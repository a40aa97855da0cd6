from urllib.parse import urljoin

from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.functions import urls as U

BASES = ["http://a.example.com/b/c/d;p?q", "https://x.example.org", "https://x.example.org/en/825?page=2&ref=x",
         "http://h.co.uk/dir/page.html#top"]
HREFS = ["g", "./g", "g/", "/g", "//g.example.net/x", "?y", "g?y", "#s", "g#s", "", "..", "../", "../g", "../..",
         "../../g", "../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h",
         "g;x=1/./y", "mailto:someone@example.com", "https://other.example.com/p", "a//b", "/the,"]


def test_resolve_url_matches_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string")
    got = {(r.base, r.href): r.out for r in df.select("base", "href", U.resolve_url("base", "href").alias("out")).collect()}
    for b, h in rows:
        assert got[(b, h)] == urljoin(b, h.split("#")[0]), (b, h)


def test_registered_domain_and_internal(spark):
    rows = [("https://m.casino-win.example.com/en/1", "example.com", True),
            ("http://user@www.shop.co.uk:8080/x", "shop.co.uk", True),
            ("/relative/path", "example.com", True),
            ("mailto:x@y.com", "example.com", True),
            ("https://other.org/p", "example.com", False)]
    df = spark.createDataFrame(rows, "u string, dom string, want boolean")
    out = df.select(U.is_internal(F.col("u"), F.col("dom")).alias("got"), "want", U.registered_domain("u").alias("rd")).collect()
    assert [r.got for r in out] == [r[2] for r in rows]
    assert out[1].rd == "shop.co.uk"


def test_is_article_rules(spark):
    cases = {
        "https://x.com/blog/my-post": True,
        "https://x.com/blog/": False,
        "https://x.com/blog": False,
        "https://x.com/blog/tag/ml": False,
        "https://x.com/About": False,
        "https://x.com/news/2024/a": True,
        "https://x.com/articles/page/2": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = {r.u: r.a for r in df.select("u", U.is_article("u").alias("a")).collect()}
    assert got == cases


def test_title_links_anchor_cleaning(spark):
    html = ('<html><head><title> A &amp; B </title><script>var t="</p>";</script></head><body>'
            '<a href="/x">one <b>two</b></a><a name="n">no href</a><a href="">empty</a>'
            "<a href='/y#frag' class=c>  spaced\n  text </a><A HREF=/z>Up</A></body>")
    df = spark.createDataFrame([(html,)], "html string")
    r = df.select(H.extract_title("html").alias("t"), H.raw_links(F.col("html")).alias("l")).first()
    assert r.t == "A & B"
    assert [(x.pos, x.href, x.anchor) for x in r.l] == [(1, "/x", "one two"), (4, "/y#frag", "spaced text"), (5, "/z", "Up")]


def test_clean_anchor_and_word_count(spark):
    df = spark.createDataFrame([(None, " a  b\tc "), ("x" * 600, "")], "a string, t string")
    out = df.select(H.clean_anchor("a").alias("c"), H.word_count("t").alias("n")).collect()
    assert out[0].c == "" and out[0].n == 3
    assert len(out[1].c) == 500 and out[1].n == 0


def test_real_world_markup(spark):
    pages = [
        '<a data-href="/x" href="/y">a</a>',
        '<!-- <a href="/no">c</a> --><script>var s = \'<a href="/no">s</a>\';</script><title>T&rsquo;s &#8212; &#x41;&amp;lt;</title>',
        '<a href="/1">one<a href="/2">two</a>',
        '<a href="/p q" title="x href=/z">sp  ace</a>',
        "<a title='href=/no' href = /u?a=1&amp;b=2>n</a><abbr href='/no'>x</abbr>",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    out = {r.i: r for r in df.select("i", H.extract_title("html").alias("t"), H.raw_links(F.col("html")).alias("l")).collect()}
    got = {i: [(x.href, x.anchor) for x in r.l] for i, r in out.items()}
    assert got == {0: [("/y", "a")], 1: [], 2: [("/1", "one"), ("/2", "two")], 3: [("/p q", "sp ace")], 4: [("/u?a=1&b=2", "n")]}
    assert out[1].t == "T’s — A&lt;"


def test_word_count_splits_like_python(spark):
    texts = ["a b c\x1cd", "  ", "x　y\x85z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(H.word_count("t").alias("n")).collect()] == [len(t.split()) for t in texts]
