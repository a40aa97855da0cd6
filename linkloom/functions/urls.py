"""URL functions as column expressions.

``resolve_url`` follows Python's ``urljoin`` (RFC 3986 merge + dot-segment
removal) with higher-order array functions, so no Python runs per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.core import let

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
ROOT_RE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"

# Two-label public suffixes under which the registered domain
# takes three labels.  A parameter of ``registered_domain``; extend as needed.
MULTI_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za",
    "com.br", "com.cn", "com.mx", "com.tr", "com.sg", "com.hk", "com.tw", "com.ar",
]

# Article detection rules.
# Built-in defaults used when no config file is readable (6 include, 17 exclude).
DEFAULT_INCLUDE = ["/articles/", "/blog/", "/posts/", "/news/", "/insights/", "/updates/"]
DEFAULT_EXCLUDE = [
    "/author/", "/authors/", "/tag/", "/tags/", "/category/", "/categories/",
    "/page/", "/archive", "/guides/", "/about/", "/contact/", "/privacy/", "/terms/",
    "/search", "/feed", "/rss", "/sitemap",
]
# Defaults applied per missing key of a config that exists (2 include, 13 exclude).
MISSING_KEY_INCLUDE = ["/articles/", "/blog/"]
MISSING_KEY_EXCLUDE = [
    "/author/", "/authors/", "/tag/", "/tags/", "/category/", "/categories/",
    "/page/", "/archive", "/guides/", "/about/", "/contact/", "/privacy/", "/terms/",
]

# Title rules declared in the site config (opt-in, B12): words that
# mark a listing title, and the minimum title length.
DEFAULT_TITLE_EXCLUDE = ["blog", "author", "tag", "category", "search", "page"]
DEFAULT_MIN_TITLE_LENGTH = 10

# Pillar-candidate exclusion (listing / non-content pages).
LISTING_CONTAINS_RE = (
    r"/author/|/authors/|/tag/|/tags/|/categories/|/category/|/archive|/guides"
    r"|/page/|/articles/page/|/articles/author/|/about/|/contact/|/privacy/|/terms/"
)
LISTING_FULL_RE = r"^https?://[^/]+/articles/?$"


@dataclass(frozen=True)
class ArticleRules:
    include: list = field(default_factory=lambda: list(DEFAULT_INCLUDE))
    exclude: list = field(default_factory=lambda: list(DEFAULT_EXCLUDE))
    title_exclude: list = field(default_factory=list)
    min_title_length: int = 0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_fragment(col) -> Column:
    return F.split_part(_c(col), F.lit("#"), F.lit(1))


def url_host(col) -> Column:
    """Lower-cased host of an absolute URL, '' for relative ones."""
    netloc = F.regexp_extract(_c(col), NETLOC_RE, 1)
    no_user = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(F.regexp_replace(no_user, r":[0-9]*$", ""))


def domain_of_host(host, suffixes=None) -> Column:
    """Registered domain of a host: last two labels, three under a multi-label suffix."""
    suffixes = MULTI_LABEL_SUFFIXES if suffixes is None else suffixes

    def body(h):
        labels = F.split(h, r"\.")
        n = F.size(labels)
        last2 = F.array_join(F.slice(labels, -2, 2), ".")
        last3 = F.array_join(F.slice(labels, -3, 3), ".")
        return (
            F.when(h == "", F.lit(""))
            .when(n <= 2, h)
            .when(last2.isin(*suffixes) & (n >= 3), last3)
            .otherwise(last2)
        )

    return let(host, body)


def registered_domain(col, suffixes=None) -> Column:
    """Registered domain of a URL ('' for relative URLs)."""
    return domain_of_host(url_host(col), suffixes)


def is_internal(col, domain, suffixes=None) -> Column:
    """No netloc -> true; else registered domain equals ``domain``."""
    dom = F.lit(domain) if isinstance(domain, str) else domain
    return let(
        url_host(col),
        lambda h: F.when(F.coalesce(h, F.lit("")) == "", F.lit(True)).otherwise(
            domain_of_host(h, suffixes) == F.lower(dom)
        ),
    )


def _remove_dots(segments: Column, relative: Column) -> Column:
    """urljoin's segment walk: '..' pops, '.' skipped, trailing dot keeps '/'."""
    n = F.size(segments)
    # relative refs drop empty middle segments
    kept = F.when(
        relative & (n > 2),
        F.concat(
            F.slice(segments, 1, 1),
            F.filter(F.slice(segments, 2, n - 2), lambda s: s != ""),
            F.slice(segments, -1, 1),
        ),
    ).otherwise(segments)
    walked = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(kept, -1)
    walked = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(walked, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def resolve_url(base, href) -> Column:
    """Cut ``href`` at the first '#', then join onto ``base`` like urljoin."""

    def with_h(b, h):
        root = F.regexp_extract(b, ROOT_RE, 0)
        bscheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        bquery = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)?", 1)
        hpath = F.regexp_extract(h, r"^([^?]*)", 1)
        hrest = F.regexp_extract(h, r"^[^?]*(\?.*)?$", 1)
        has_netloc = F.regexp_extract(b, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", 0) != ""

        def with_path(bpath):
            bdir = F.regexp_extract(bpath, r"^(.*/)", 1)
            base_dir = F.when(bdir != "", bdir).otherwise(F.when(has_netloc, F.lit("/")).otherwise(F.lit("")))
            abs_path = hpath.startswith("/")

            def with_merged(merged):
                segs = F.split(merged, "/", -1)
                needs_dots = merged.rlike(r"(^|/)\.\.?(/|$)") | (~abs_path & merged.rlike("//"))
                walked = _remove_dots(segs, ~abs_path)
                # an authority forces a rooted path (urlunsplit adds the '/')
                walked = F.when(has_netloc & ~walked.startswith("/"), F.concat(F.lit("/"), walked)).otherwise(walked)
                clean_path = F.when(needs_dots, walked).otherwise(merged)
                return (
                    F.when(h == "", b)
                    .when(h.rlike(SCHEME_RE), h)
                    .when(h.startswith("//"), F.concat(bscheme, F.lit(":"), h))
                    .when(hpath == "", F.concat(root, bpath, F.when(hrest != "", hrest).otherwise(bquery)))
                    .otherwise(F.concat(root, clean_path, hrest))
                )

            return let(F.when(abs_path, hpath).otherwise(F.concat(base_dir, hpath)), with_merged)

        return let(F.regexp_extract(b, PATH_RE, 1), with_path)

    return let(_c(base), lambda b: let(strip_fragment(href), lambda h: with_h(b, h)))


def is_article(col, rules: ArticleRules | None = None) -> Column:
    """Contains an include pattern, no exclude pattern, and is not the root listing."""
    rules = rules or ArticleRules()
    u = F.lower(_c(col))
    inc = F.lit(False)
    for p in rules.include:
        inc = inc | u.contains(p)
    exc = F.lit(False)
    for p in rules.exclude:
        exc = exc | u.contains(p)
    stripped = F.regexp_replace(u, r"/+$", "")
    root = F.lit(False)
    for p in rules.include:
        root = root | stripped.endswith(p.rstrip("/"))
    return inc & ~exc & ~root


def title_ok(title, rules: ArticleRules) -> Column:
    """B12 (opt-in): title rules declared in config; default rules keep everything."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    ok = F.length(t) >= F.lit(rules.min_title_length)
    for p in rules.title_exclude:
        ok = ok & ~t.contains(p)
    return ok


def is_listing_url(col) -> Column:
    """Listing / author / tag / legal pages, never pillars."""
    u = F.lower(_c(col))
    return u.rlike(LISTING_CONTAINS_RE) | u.rlike(LISTING_FULL_RE)


def canonical_url(col) -> Column:
    """B13 (opt-in, not in the reference): unify mirror URLs.

    https, no ``www.``/``m.`` host prefix, no query, fragment or trailing slash,
    lower-case host.
    """
    c = strip_fragment(col)
    c = F.regexp_replace(c, r"\?.*$", "")
    host = F.regexp_replace(url_host(c), r"^(www|m)\.", "")
    path = F.regexp_extract(c, PATH_RE, 1)
    path = F.regexp_replace(path, r"/+$", "")
    return F.when(host == "", path).otherwise(F.concat(F.lit("https://"), host, path))
