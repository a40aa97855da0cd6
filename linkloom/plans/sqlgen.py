"""Small helpers that write DuckDB SQL from the same fixed values the Spark
expressions use (regex strings, entity table, rule lists)."""

from __future__ import annotations

from linkloom.functions import html as H

# The oracle's own extraction, for the regular markup of the given pages: closed
# links, quoted hrefs, and these entities.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]

ANCHOR_ELEM_RE = r"(?is)<a\b[^>]*>.*?</a>"
HREF_RE = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)"""
INNER_RE = r"(?is)^<a\b[^>]*>(.*)</a>$"
WS_RE = r"\s+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def unescape(expr: str) -> str:
    out = expr
    for ent, ch in ENTITIES:
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def rx_replace(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def clean_anchor(expr: str) -> str:
    return f"coalesce(substring(trim({rx_replace(expr, WS_RE, ' ')}), 1, 500), '')"


def title(expr: str = "html") -> str:
    raw = f"regexp_extract({expr}, {q(H.TITLE_RE)}, 1)"
    return rx_replace(unescape(rx_replace(raw, H.TAG_RE, "")), r"^\s+|\s+$", "")


def text(expr: str = "html") -> str:
    c = expr
    for pat in H.DROP_RES:
        c = rx_replace(c, pat, " ")
    c = rx_replace(c, r"(?is)<title[^>]*>.*?</title>", " ")
    c = rx_replace(c, H.TAG_RE, " ")
    return f"trim({rx_replace(unescape(c), WS_RE, ' ')})"


def host(expr: str) -> str:
    netloc = f"regexp_extract({expr}, {q('^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)')}, 1)"
    return f"lower(regexp_replace(regexp_replace({netloc}, '^.*@', ''), ':[0-9]*$', ''))"


def registered_domain(expr: str, suffixes) -> str:
    h = host(expr)
    labels = f"string_split({h}, '.')"
    last2 = f"array_to_string({labels}[-2:], '.')"
    last3 = f"array_to_string({labels}[-3:], '.')"
    sl = ", ".join(q(s) for s in suffixes)
    return (
        f"(CASE WHEN {h} = '' THEN '' WHEN len({labels}) <= 2 THEN {h} "
        f"WHEN {last2} IN ({sl}) THEN {last3} ELSE {last2} END)"
    )


def resolve_simple(base: str, href: str) -> str:
    """urljoin for references without dot segments (the oracle's data)."""
    h = f"split_part({href}, '#', 1)"
    root = f"regexp_extract({base}, {q('^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?')}, 0)"
    bscheme = f"regexp_extract({base}, {q('^([A-Za-z][A-Za-z0-9+.-]*):')}, 1)"
    bpath = f"regexp_extract({base}, {q('^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)')}, 1)"
    bdir = f"regexp_extract({bpath}, '^(.*/)', 1)"
    return (
        f"(CASE WHEN {h} = '' THEN {base} "
        f"WHEN regexp_matches({h}, {q('^[A-Za-z][A-Za-z0-9+.-]*:')}) THEN {h} "
        f"WHEN starts_with({h}, '//') THEN {bscheme} || ':' || {h} "
        f"WHEN starts_with({h}, '/') THEN {root} || {h} "
        f"WHEN starts_with({h}, '?') THEN {root} || {bpath} || {h} "
        f"ELSE {root} || (CASE WHEN {bdir} = '' THEN '/' ELSE {bdir} END) || {h} END)"
    )
