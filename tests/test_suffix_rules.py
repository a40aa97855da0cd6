"""Suffix rules with wildcards and exceptions; sitemaps that are gzip by content."""

import gzip

from linkloom.operators import suffixes as S
from linkloom.sources import sitemaps

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "// note", "", "  ORG "]


def expected(host):
    labels = host.split(".")
    best = (False, 0)
    for r in RULES:
        r = r.strip().lower()
        if not r or r.startswith("//"):
            continue
        want = r.lstrip("!").split(".")
        if len(labels) >= len(want) and all(w in ("*", x) for w, x in zip(want, labels[-len(want):])):
            best = max(best, (r.startswith("!"), len(want)))
    n = best[1] - best[0] if best[1] else 1
    return ".".join(labels[-n - 1:])


def test_registered_domains(spark):
    hosts = ["a.b.example.com", "example.com", "com", "x.co.uk", "a.x.co.uk", "co.uk", "foo.ck", "a.foo.ck", "b.a.foo.ck", "www.ck", "a.www.ck", "x.kawasaki.jp",
             "a.x.kawasaki.jp", "b.a.x.kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp", "other.test", "a.other.test", "localhost", "a.b.org"]
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    got = {r.host: r.domain for r in S.registered_domains(spark.createDataFrame([(h,) for h in hosts * 2], "host string"), rules).collect()}
    assert got == {h: expected(h) for h in hosts}
    assert got["a.foo.ck"] == "a.foo.ck" and got["b.a.foo.ck"] == "a.foo.ck" and got["a.www.ck"] == "www.ck" and got["a.city.kawasaki.jp"] == "city.kawasaki.jp"
    urls = ["https://B.a.foo.ck/x", "/relative", None, "http://10.0.0.1/x", "https://a.www.ck:80/"]
    df = spark.createDataFrame([(u, "v") for u in urls], "url string, domain0 string")
    assert [r.domain for r in sorted(S.with_registered_domain(df, rules).collect(), key=lambda r: urls.index(r.url))] == ["a.foo.ck", "", "", "10.0.0.1", "www.ck"]
    links = spark.createDataFrame([("https://x.co.uk/a", "x.co.uk"), ("https://y.co.uk/a", "x.co.uk"), ("/b", "x.co.uk")], "href string, domain string")
    assert sorted(r.href for r in S.internal_links(links, rules).collect()) == ["/b", "https://x.co.uk/a"]
    none = spark.createDataFrame([], "rule string")
    assert {r.domain for r in S.registered_domains(spark.createDataFrame([("a.b.c",)], "host string"), none).collect()} == {"b.c"}


def test_gzip_by_content(spark, tmp_path):
    body = "<?xml version='1.0'?><urlset><url><loc>https://a.com/é</loc></url></urlset>"
    (tmp_path / "plain.xml").write_text(body)
    (tmp_path / "packed.xml").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "named.xml.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "only_named.xml.gz").write_text(body)
    (tmp_path / "broken.xml").write_bytes(gzip.compress(body.encode())[:-12])
    (tmp_path / "bytes.xml").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "empty.xml").write_bytes(b"")
    got = {r.sitemap_url: r.body for r in sitemaps.read_sitemap_files(spark, str(tmp_path), "s").collect()}
    assert got == {"plain.xml": body, "packed.xml": body, "named.xml": body, "only_named.xml": body}
