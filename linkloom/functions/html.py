"""Page extraction as column expressions.

Everything here is a JVM-side expression (regex + higher-order functions) and
needs no Python per row.  Comments, scripts and styles are removed before titles
and links are looked for; white space is Unicode's.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
# A link runs from its tag to the next link, its end tag or the end of the page.
ANCHOR_RE = r"(?is)<a(?=[\s/>]).*?(?=<a[\s/>]|</a[\s>]|\z)"
A_TAG_RE = r"""(?is)^<a((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>?"""
# Attributes before href are passed over whole, so neither data-href nor a value that mentions href counts.
HREF_RE = (r"""(?is)^(?:[\s/]++|(?!href[\s=])[^\s=/>]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
           r"""href\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""")
TAG_RE = r"<[^>]*>"
WS_RE = r"[\s\x1c-\x1f\x85\p{Z}]+"
HIDDEN_RES = [
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
    r"(?s)<!--.*?-->",
]
ENTITY_RE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Regions dropped before text extraction (B4 stand-in): scripts, styles,
# comments, navigation, footer, tables and ad blocks.
DROP_RES = [
    r"(?is)<script\b[^>]*>.*?</script>",
    r"(?is)<style\b[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
    r"(?is)<nav\b[^>]*>.*?</nav>",
    r"(?is)<footer\b[^>]*>.*?</footer>",
    r"(?is)<table\b[^>]*>.*?</table>",
    r"(?is)<div class=\"ad\">.*?</div>",
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unescape(col) -> Column:
    """Decode named (HTML 4) and numeric entities; unknown ones stay as they are."""
    text = _c(col)
    # apos is the one name that HTML 4 lacks
    names = F.create_map(*[F.lit(x) for n, c in {**name2codepoint, "apos": 39}.items() for x in (n, chr(c))])

    def decoded(e):
        body = F.substring(e, 2, F.length(e) - 2)
        code = F.when(
            F.lower(F.substring(body, 1, 2)) == "#x", F.conv(F.substring(body, 3, 8), 16, 10)).when(
            F.substring(body, 1, 1) == "#", F.substring(body, 2, 8)).cast("long")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        by_code = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.element_at(names, body), by_code, e)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_RE), 0))
    # a decoded "&" must not begin another entity: those come last
    order = F.concat(F.filter(found, lambda e: decoded(e) != "&"), F.filter(found, lambda e: decoded(e) == "&"))
    return F.when(text.contains("&"), F.aggregate(order, text, lambda acc, e: F.replace(acc, e, decoded(e)))).otherwise(text)


def visible(html) -> Column:
    """The page without comments, scripts and styles."""
    out = _c(html)
    for pattern in HIDDEN_RES:
        out = F.regexp_replace(out, pattern, " ")
    return out


def clean_anchor(col) -> Column:
    """Whitespace runs -> one space, trim, first 500 chars; null -> ''."""
    c = F.trim(F.regexp_replace(_c(col), WS_RE, " "))
    return F.coalesce(F.substring(c, 1, 500), F.lit(""))


def extract_title(html) -> Column:
    """B1: text of the first <title>, tags stripped, entities decoded, trimmed."""
    raw = F.regexp_extract(visible(html), TITLE_RE, 1)
    return F.regexp_replace(unescape(F.regexp_replace(raw, TAG_RE, "")), f"^{WS_RE}|{WS_RE}$", "")


def raw_links(html) -> Column:
    """B2: ARRAY<STRUCT<pos INT, href STRING, anchor STRING>> in document order.

    ``pos`` is 1-based.  Empty hrefs are dropped (as the reference does) but
    the position numbering keeps the original order.
    """
    elems = F.regexp_extract_all(visible(html), F.lit(ANCHOR_RE), 0)

    def link(e, i):
        attributes = F.regexp_extract(e, A_TAG_RE, 1)
        href = F.concat(*[F.regexp_extract(attributes, HREF_RE, g) for g in (1, 2, 3)])
        inner = F.regexp_replace(F.regexp_replace(e, A_TAG_RE, ""), TAG_RE, " ")
        return F.struct((i + 1).cast("int").alias("pos"), unescape(href).alias("href"), clean_anchor(unescape(inner)).alias("anchor"))

    with_pos = F.transform(elems, link)
    return F.filter(with_pos, lambda s: s["href"] != "")


def extract_text(html) -> Column:
    """B4 stand-in for a boilerplate-removing text extractor.

    Drops scripts, styles, comments, nav, footer, tables and ad blocks, then
    strips tags, decodes entities and collapses whitespace.  Not byte-equal to
    a statistical extractor; deterministic and SQL-reproducible.
    """
    c = _c(html)
    for pat in DROP_RES:
        c = F.regexp_replace(c, pat, " ")
    c = F.regexp_replace(c, r"(?is)<title[^>]*>.*?</title>", " ")
    c = F.regexp_replace(c, TAG_RE, " ")
    return F.trim(F.regexp_replace(unescape(c), WS_RE, " "))


def text_or_title(text, title) -> Column:
    """Text falls back to title when empty."""
    return F.coalesce(F.nullif(_c(text), F.lit("")), _c(title))


def excerpt(col, n: int = 500) -> Column:
    return F.substring(_c(col), 1, n)


def word_count(col) -> Column:
    """len(text.split()) — runs of non-whitespace."""
    return F.size(F.filter(F.split(F.coalesce(_c(col), F.lit("")), WS_RE), lambda x: x != "")).cast("bigint")
