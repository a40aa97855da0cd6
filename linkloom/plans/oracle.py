"""DuckDB oracle SQL, one statement per registered query (same column names).

Written independently of the Spark plans: the iterative operators are
unrolled into materialized CTEs (PageRank rounds, BFS levels) and betweenness
uses the pair formula  bc(v) = sum sigma(s,v) sigma(v,t) / sigma(s,t)  over
d(s,v) + d(v,t) = d(s,t), not Brandes accumulation.
"""

from __future__ import annotations

from linkloom.functions import html as H
from linkloom.functions import urls as U
from linkloom.plans import fixtures as FX
from linkloom.plans.sqlgen import (
    ANCHOR_ELEM_RE, HREF_RE, INNER_RE,
    clean_anchor, q, registered_domain, resolve_simple, rx_replace, text, title, unescape,
)

ORACLE: dict[str, str] = {}

SITE_DOMAIN = registered_domain("url", U.MULTI_LABEL_SUFFIXES)

PAGES = f"pages_s AS (SELECT {SITE_DOMAIN} AS site, url, html FROM pages)"

LINKS = f"""
links_raw AS (
  SELECT url AS src, unnest(generate_series(1, len(el))) AS pos, unnest(el) AS e
  FROM (SELECT url, regexp_extract_all(html, {q(ANCHOR_ELEM_RE)}, 0) AS el FROM pages)
),
links AS (
  SELECT src, CAST(pos AS INTEGER) AS pos,
         {unescape(f"regexp_extract(e, {q(HREF_RE)}, 1)")} AS href,
         {clean_anchor(unescape(f"regexp_replace(regexp_extract(e, {q(INNER_RE)}, 1), {q(H.TAG_RE)}, ' ', 'g')"))} AS anchor
  FROM links_raw
),
links_ok AS (SELECT * FROM links WHERE href <> ''),
resolved AS (SELECT src, pos, href AS raw_href, {resolve_simple('src', 'href')} AS href, anchor FROM links_ok)
"""

from linkloom.plans.sqlgen import host as _host  # noqa: E402

INTERNAL = (
    f"CASE WHEN {_host('href')} = '' THEN TRUE "
    f"ELSE {registered_domain('href', U.MULTI_LABEL_SUFFIXES)} = {registered_domain('src', U.MULTI_LABEL_SUFFIXES)} END"
)


def click_ctes() -> str:
    return """
clicks AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt
           FROM events WHERE event_type = 'click'),
cnodes AS (SELECT DISTINCT user_id AS url FROM events WHERE event_type = 'click'),
cedges AS (SELECT user_id AS source, nxt AS target, count(*) AS weight
           FROM clicks WHERE nxt IS NOT NULL GROUP BY 1, 2)
"""


def users_rule(name: str, rule) -> str:
    etype, minv = rule
    return f"{name} AS (SELECT DISTINCT user_id AS url FROM events WHERE event_type = {q(etype)} AND value >= {minv})"


def pagerank_sql(nodes: str, edges: str, rounds: int, tol: float, alpha: float = 0.85) -> str:
    """Unrolled power iteration; a converged vector is frozen (err < n*tol)."""
    parts = [
        f"pn AS (SELECT url FROM {nodes})",
        "pcount AS (SELECT count(*)::DOUBLE AS n FROM pn)",
        f"pe AS (SELECT source, target, sum(coalesce(weight, 1))::DOUBLE AS w FROM {edges} GROUP BY 1, 2)",
        "pow AS (SELECT source, sum(w) AS out_w FROM pe GROUP BY 1)",
        "ptr AS (SELECT pe.source, pe.target, pe.w / pow.out_w AS p FROM pe JOIN pow USING (source))",
        "pdang AS (SELECT url FROM pn WHERE url NOT IN (SELECT source FROM pow WHERE out_w > 0))",
        "x0 AS MATERIALIZED (SELECT url, 1.0 / n AS x, FALSE AS done FROM pn, pcount)",
    ]
    for i in range(1, rounds + 1):
        p = f"x{i-1}"
        parts.append(f"""x{i}_raw AS MATERIALIZED (
  SELECT pn.url, {p}.x AS x_old, {p}.done AS done_old,
         CASE WHEN {p}.done THEN {p}.x ELSE
           {alpha} * (coalesce(c.c, 0) + coalesce((SELECT sum(x) FROM {p} WHERE url IN (SELECT url FROM pdang)), 0) / pcount.n)
           + {1.0 - alpha} / pcount.n END AS x
  FROM pn JOIN {p} USING (url) CROSS JOIN pcount
  LEFT JOIN (SELECT ptr.target AS url, sum({p}.x * ptr.p) AS c FROM {p} JOIN ptr ON {p}.url = ptr.source GROUP BY 1) c USING (url)
)""")
        parts.append(f"""x{i} AS MATERIALIZED (
  SELECT url, x, done_old OR ((SELECT sum(abs(x - x_old)) FROM x{i}_raw) < (SELECT n FROM pcount) * {tol}) AS done
  FROM x{i}_raw
)""")
    return ",\n".join(parts) + f",\npr_final AS (SELECT url, x AS pagerank FROM x{rounds})"


def bfs_sql(nodes: str, edges: str, levels: int = 12) -> str:
    """Unrolled BFS levels -> dist(s, v, d, sigma)."""
    parts = [
        f"arcs AS (SELECT DISTINCT source AS v, target AS w FROM {edges} WHERE source <> target)",
        f"l0 AS MATERIALIZED (SELECT url AS s, url AS v, 0 AS d, 1.0::DOUBLE AS sigma FROM {nodes})",
    ]
    seen = ["l0"]
    for i in range(1, levels + 1):
        seen_union = " UNION ALL ".join(f"SELECT s, v FROM {x}" for x in seen)
        parts.append(f"""l{i} AS MATERIALIZED (
  SELECT f.s, a.w AS v, {i} AS d, sum(f.sigma) AS sigma
  FROM l{i-1} f JOIN arcs a ON f.v = a.v
  WHERE NOT EXISTS (SELECT 1 FROM ({seen_union}) z WHERE z.s = f.s AND z.v = a.w)
  GROUP BY 1, 2
)""")
        seen.append(f"l{i}")
    parts.append("dist AS (" + " UNION ALL ".join(f"SELECT * FROM {x}" for x in seen) + ")")
    return ",\n".join(parts)


def closeness_sql(nodes: str) -> str:
    return f"""
cl_agg AS (SELECT v AS url, count(*)::DOUBLE AS r1, sum(d)::DOUBLE AS tot FROM dist WHERE d > 0 GROUP BY 1),
cl_final AS (
  SELECT n.url, CASE WHEN tot > 0 AND c.n > 1 THEN r1 / tot * (r1 / (c.n - 1)) ELSE 0.0 END AS closeness
  FROM {nodes} n CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM {nodes}) c LEFT JOIN cl_agg USING (url)
)"""


def betweenness_sql(nodes: str, sampled: int | None = None) -> str:
    among = f"AND a.s IN (SELECT url FROM {nodes} ORDER BY url LIMIT {sampled})" if sampled else ""
    grow = f"* c.n / least(c.n, {sampled})" if sampled else ""
    return f"""
bc_raw AS (
  SELECT a.v AS url, sum(a.sigma * b.sigma / st.sigma) AS bc
  FROM dist a JOIN dist b ON a.v = b.s JOIN dist st ON st.s = a.s AND st.v = b.v
  WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = st.d AND a.s <> b.v {among}
  GROUP BY 1
),
bc_final AS (
  SELECT n.url, CASE WHEN c.n > 2 THEN coalesce(bc, 0) {grow} / ((c.n - 1) * (c.n - 2)) ELSE coalesce(bc, 0) END AS betweenness
  FROM {nodes} n CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM {nodes}) c LEFT JOIN bc_raw USING (url)
)"""


def degree_sql(nodes: str, edges: str) -> str:
    return f"""
de AS (SELECT DISTINCT source, target FROM {edges}),
deg_final AS (
  SELECT n.url, coalesce(i.c, 0)::DOUBLE AS in_degree, coalesce(o.c, 0)::DOUBLE AS out_degree
  FROM {nodes} n
  LEFT JOIN (SELECT target AS url, count(*) AS c FROM de GROUP BY 1) i USING (url)
  LEFT JOIN (SELECT source AS url, count(*) AS c FROM de GROUP BY 1) o USING (url)
)"""


def oracle(name):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


# ------------------------------------------------------------------ B

@oracle("page_titles")
def _():
    return f"SELECT url, {title('html')} AS title FROM pages"


@oracle("page_links")
def _():
    return f"WITH {LINKS} SELECT src, pos, href, anchor FROM links_ok"


@oracle("resolved_links")
def _():
    return f"WITH {LINKS} SELECT src, pos, raw_href, href FROM resolved"


@oracle("internal_links")
def _():
    return f"WITH {LINKS} SELECT src, count(*) AS n_internal FROM resolved WHERE {INTERNAL} GROUP BY 1"


def _is_article_sql(col: str) -> str:
    u = f"lower({col})"
    inc = " OR ".join(f"contains({u}, {q(p)})" for p in U.DEFAULT_INCLUDE)
    exc = " OR ".join(f"contains({u}, {q(p)})" for p in U.DEFAULT_EXCLUDE)
    root = " OR ".join(f"ends_with(regexp_replace({u}, '/+$', ''), {q(p.rstrip('/'))})" for p in U.DEFAULT_INCLUDE)
    return f"(({inc}) AND NOT ({exc}) AND NOT ({root}))"


@oracle("article_flags")
def _():
    return f"SELECT url, {_is_article_sql('url')} AS is_article, {SITE_DOMAIN} AS domain FROM pages"


@oracle("listing_flags")
def _():
    return (f"SELECT url, (regexp_matches(lower(url), {q(U.LISTING_CONTAINS_RE)}) "
            f"OR regexp_full_match(lower(url), {q(U.LISTING_FULL_RE)})) AS is_listing FROM pages")


@oracle("canonical_urls")
def _():
    c0 = "regexp_replace(split_part(url, '#', 1), '\\?.*$', '')"
    from linkloom.plans.sqlgen import host
    h = f"regexp_replace({host(c0)}, '^(www|m)\\.', '')"
    path = f"regexp_replace(regexp_extract({c0}, {q(U.PATH_RE)}, 1), '/+$', '')"
    can = f"CASE WHEN {h} = '' THEN {path} ELSE 'https://' || {h} || {path} END"
    return f"SELECT canonical, count(*) AS n_urls, min(url) AS first_url FROM (SELECT url, {can} AS canonical FROM pages) GROUP BY 1"


@oracle("page_text_stats")
def _():
    t = f"coalesce(nullif({text('html')}, ''), {title('html')})"
    return f"""SELECT url, len(list_filter(regexp_split_to_array(coalesce(t, ''), '\\s+'), lambda x: x <> ''))::BIGINT AS word_count,
       length(substring(t, 1, 500)) AS excerpt_chars, sha256(t) AS text_sha
FROM (SELECT url, {t} AS t FROM pages)"""


# ------------------------------------------------------------------ D

@oracle("link_edges")
def _():
    return f"""WITH {LINKS},
internal AS (SELECT * FROM resolved WHERE {INTERNAL}),
grp AS (
  SELECT src AS source, href AS target, count(*) AS weight,
         list(anchor ORDER BY pos)[1:{50}] AS anchors
  FROM internal GROUP BY 1, 2
)
SELECT source, target, weight,
       coalesce(substring(array_to_string(list_sort(list_distinct(list_filter(anchors, lambda x: x <> ''))), ' | '), 1, 2000), '') AS anchors
FROM grp"""


@oracle("click_edges")
def _():
    return f"WITH {click_ctes()} SELECT source, target, weight FROM cedges"


@oracle("crawled_edges")
def _():
    return f"""WITH {click_ctes()}, {users_rule('crawled', FX.CRAWLED_RULE)}
SELECT user_id AS source, nxt AS target, count(*) AS weight FROM clicks
WHERE nxt IS NOT NULL AND nxt IN (SELECT url FROM crawled) GROUP BY 1, 2"""


@oracle("subgraph_edges")
def _():
    return f"""WITH {click_ctes()}, {users_rule('art', FX.ARTICLE_RULE)}
SELECT source, target, weight FROM cedges
WHERE source IN (SELECT url FROM art) AND target IN (SELECT url FROM art)"""


# ------------------------------------------------------------------ E

@oracle("degrees")
def _():
    return f"WITH {click_ctes()}, {degree_sql('cnodes', 'cedges')} SELECT url, in_degree, out_degree FROM deg_final"


@oracle("pagerank_20")
def _():
    return f"WITH {click_ctes()}, {pagerank_sql('cnodes', 'cedges', 20, 0.0)} SELECT url, round(pagerank, 6) AS pagerank FROM pr_final"


@oracle("pagerank")
def _():
    return f"WITH {click_ctes()}, {pagerank_sql('cnodes', 'cedges', 100, 1e-6)} SELECT url, round(pagerank, 6) AS pagerank FROM pr_final"


@oracle("pagerank_dangling")
def _():
    return f"""WITH {click_ctes()}, {users_rule('dropout', FX.DANGLING_RULE)},
dedges AS (SELECT * FROM cedges WHERE source NOT IN (SELECT url FROM dropout)),
{pagerank_sql('cnodes', 'dedges', 100, 1e-6)}
SELECT url, round(pagerank, 6) AS pagerank FROM pr_final"""


@oracle("closeness")
def _():
    return f"WITH {click_ctes()}, {bfs_sql('cnodes', 'cedges')}, {closeness_sql('cnodes')} SELECT url, round(closeness, 6) AS closeness FROM cl_final"


@oracle("betweenness")
def _():
    return f"WITH {click_ctes()}, {bfs_sql('cnodes', 'cedges')}, {betweenness_sql('cnodes')} SELECT url, round(betweenness, 6) AS betweenness FROM bc_final"


@oracle("betweenness_sampled")
def _():
    return f"WITH {click_ctes()}, {bfs_sql('cnodes', 'cedges')}, {betweenness_sql('cnodes', 50)} SELECT url, round(betweenness, 6) AS betweenness FROM bc_final"


@oracle("centrality")
def _():
    return f"""WITH {click_ctes()}, {users_rule('art', FX.ARTICLE_RULE)},
aedges AS (SELECT * FROM cedges WHERE source IN (SELECT url FROM art) AND target IN (SELECT url FROM art)),
{pagerank_sql('art', 'aedges', 100, 1e-6)},
{bfs_sql('art', 'aedges')},
{closeness_sql('art')},
{betweenness_sql('art')},
{degree_sql('art', 'aedges')}
SELECT a.url, round(coalesce(p.pagerank, 0), 6) AS pagerank, round(coalesce(b.betweenness, 0), 6) AS betweenness,
       round(coalesce(c.closeness, 0), 6) AS closeness, round(d.in_degree, 6) AS in_degree, round(d.out_degree, 6) AS out_degree
FROM art a LEFT JOIN pr_final p USING (url) LEFT JOIN bc_final b USING (url)
LEFT JOIN cl_final c USING (url) LEFT JOIN deg_final d USING (url)"""


# ------------------------------------------------------------------ F

from linkloom.functions import text as T  # noqa: E402

STOPS = "[" + ", ".join(q(w) for w in T.spark_stop_words()) + "]"


def tfidf_ctes(docs_sql: str, max_features: int | None = None) -> str:
    cap = f"WHERE rank <= {max_features}" if max_features else ""
    return f"""
tdocs AS ({docs_sql}),
toks AS (SELECT site, url, list_filter(regexp_extract_all(lower(coalesce(text, '')), {q(T.TOKEN_RE)}, 0),
                                 lambda x: NOT list_contains({STOPS}, x)) AS t FROM tdocs),
grams AS (SELECT site, url, unnest(list_concat(t, CASE WHEN len(t) >= 2
            THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM toks),
tf AS (SELECT site, url, term, count(*) AS tf FROM grams GROUP BY 1, 2, 3),
tstats AS (SELECT site, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1, 2 HAVING count(*) >= 2),
voc AS (SELECT * FROM (SELECT site, term, df, cf, row_number() OVER (PARTITION BY site ORDER BY cf DESC, term ASC) AS rank FROM tstats)
        {cap}),
ndocs AS (SELECT site, count(*)::DOUBLE AS n FROM tdocs GROUP BY site),
w0 AS (SELECT tf.site, tf.url, tf.term, tf.tf, voc.df, tf.tf * (ln((1.0 + ndocs.n) / (1.0 + voc.df)) + 1.0) AS w0
       FROM tf JOIN voc USING (site, term) JOIN ndocs USING (site)),
tw AS (SELECT site, url, term, tf, df, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY url)) AS w FROM w0),
dkw AS (SELECT * FROM (SELECT site, url, term, w, row_number() OVER (PARTITION BY url ORDER BY round(w, 12) DESC, term) AS rk FROM tw)
        WHERE rk <= 20)"""


LANG_DOCS = "SELECT lang AS site, doc_id AS url, text FROM documents"
LABELED_DOCS = ("SELECT 'docs' AS site, d.doc_id AS url, d.text, e.label AS cluster FROM documents d "
                "JOIN embeddings e ON d.doc_id = e.vec_id")


@oracle("term_stats")
def _():
    return f"WITH {tfidf_ctes(LANG_DOCS)} SELECT site, term, df, cf, rank FROM voc"


@oracle("vocabulary_top")
def _():
    return f"WITH {tfidf_ctes(LANG_DOCS, 1000)} SELECT site, term, df, cf, rank FROM voc"


@oracle("tfidf_weights")
def _():
    return f"WITH {tfidf_ctes(LANG_DOCS)} SELECT site, url, term, tf, df, round(w, 6) AS w FROM tw"


@oracle("doc_keywords")
def _():
    return f"WITH {tfidf_ctes(LANG_DOCS)} SELECT url, array_to_string(list(term ORDER BY rk), '; ') AS keywords FROM dkw GROUP BY url"


@oracle("cluster_keywords")
def _():
    return f"""WITH {tfidf_ctes(LABELED_DOCS)},
csum AS (SELECT l.cluster, k.term, sum(k.w) AS score FROM dkw k JOIN tdocs l USING (url) GROUP BY 1, 2),
crank AS (SELECT * FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rk
          FROM csum) WHERE rk <= 15)
SELECT cluster, array_to_string(list(term ORDER BY rk), ', ') AS keywords FROM crank GROUP BY cluster"""


@oracle("tfidf_centroid_sim")
def _():
    return f"""WITH {tfidf_ctes(LABELED_DOCS)},
members AS (SELECT cluster, count(*)::DOUBLE AS m FROM tdocs GROUP BY 1),
mu AS (SELECT l.cluster, t.term, sum(t.w) / any_value(members.m) AS mu
       FROM tw t JOIN tdocs l USING (url) JOIN members USING (cluster) GROUP BY 1, 2),
cen AS (SELECT cluster, term, mu / (sqrt(sum(mu * mu) OVER (PARTITION BY cluster)) + 1e-9) AS c FROM mu),
dots AS (SELECT t.url, sum(t.w * cen.c) AS sim FROM tw t JOIN tdocs l USING (url) JOIN cen ON cen.cluster = l.cluster AND cen.term = t.term
         GROUP BY 1)
SELECT l.url, l.cluster, round(coalesce(dots.sim, 0.0), 6) AS pillar_sim FROM tdocs l LEFT JOIN dots USING (url)"""


# ------------------------------------------------------------------ G

VEC_CTES = """
vecs AS (SELECT vec_id AS url, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
vnorm AS (SELECT url, cluster, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nrm FROM vecs),
unit AS (SELECT url, cluster, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS u FROM vnorm),
unit9 AS (SELECT url, cluster, list_transform(v, lambda x: x / (nrm + 1e-9)) AS u FROM vnorm),
cpos AS (SELECT cluster, unnest(range(1, len(u) + 1)) AS pos, unnest(u) AS x FROM unit9),
cmean AS (SELECT cluster, list(m ORDER BY pos) AS mean FROM (SELECT cluster, pos, avg(x) AS m FROM cpos GROUP BY 1, 2) GROUP BY 1),
cnorm AS (SELECT cluster, mean, sqrt(list_sum(list_transform(mean, lambda y: y * y))) AS nrm FROM cmean),
cent AS (SELECT cluster, list_transform(mean, lambda x: x / (nrm + 1e-9)) AS c FROM cnorm)
"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


@oracle("dense_centroid_sim")
def _():
    return f"""WITH {VEC_CTES}
SELECT unit9.url, unit9.cluster, round({_dot('unit9.u', 'cent.c')}, 6) AS semantic_sim FROM unit9 JOIN cent USING (cluster)"""


@oracle("nearest_centroid")
def _():
    d2 = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - c.c[i]) * (a.v[i] - c.c[i])))"
    return f"""WITH {VEC_CTES},
d AS (SELECT a.url, c.cluster, {d2} AS d2 FROM vecs a CROSS JOIN cent c),
r AS (SELECT url, cluster, d2, row_number() OVER (PARTITION BY url ORDER BY d2, cluster) AS rn FROM d)
SELECT url, cluster, round(sqrt(d2), 6) AS dist FROM r WHERE rn = 1"""


@oracle("topic_similarity")
def _():
    return f"""WITH {VEC_CTES},
t AS (SELECT v AS tv, nrm AS tn FROM vnorm WHERE url = 0)
SELECT url, round(CASE WHEN nrm * tn > 0 THEN {_dot('v', 'tv')} / (nrm * tn) ELSE 0.0 END, 6) AS sim
FROM vnorm CROSS JOIN t"""


PAIRS = f"pairs AS (SELECT a.url AS source, b.url AS target, {_dot('a.u', 'b.u')} AS sim FROM unit a JOIN unit b ON a.url <> b.url)"


@oracle("nearest_neighbors")
def _():
    return f"""WITH {VEC_CTES}, {PAIRS},
r AS (SELECT source, target, sim, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM pairs)
SELECT source AS url, target AS neighbor, round(sim, 6) AS sim, rank FROM r WHERE rank <= 5"""


@oracle("nearest_neighbors_bounded")
def _():
    return f"""WITH {VEC_CTES}, {PAIRS},
r AS (SELECT source, target, sim, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM pairs)
SELECT source AS url, target AS neighbor, round(sim, 6) AS sim, rank FROM r WHERE rank <= 3"""


def _recommend(min_sim: float) -> str:
    from linkloom.operators.similarity import RECOMMEND_REASON
    return f"""WITH {VEC_CTES}, {click_ctes()}, {PAIRS},
ok AS (SELECT * FROM pairs p WHERE sim >= {min_sim}
       AND NOT EXISTS (SELECT 1 FROM cedges e WHERE e.source = p.source AND e.target = p.target)),
r AS (SELECT source, target, sim, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rk FROM ok)
SELECT source AS source_url, target AS target_url, round(sim, 4) AS similarity, {q(RECOMMEND_REASON)} AS reason
FROM r WHERE rk <= 3"""


@oracle("recommend_links")
def _():
    return _recommend(0.25)


@oracle("recommend_links_strict")
def _():
    return _recommend(0.5)


@oracle("pillars")
def _():
    mem = ("SELECT 'docs' AS site, d.doc_id AS url, d.text, e.label AS cluster, CAST(e.embedding AS DOUBLE[]) AS v, "
           "split_part(d.text, chr(10), 1) AS title FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
    wc = "len(list_filter(regexp_split_to_array(coalesce(m.text, ''), '\\s+'), lambda x: x <> ''))"
    return f"""WITH {tfidf_ctes(mem)}, {click_ctes()}, {pagerank_sql('cnodes', 'cedges', 100, 1e-6)},
vn AS (SELECT url, cluster, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nrm FROM tdocs),
u9 AS (SELECT url, cluster, list_transform(v, lambda x: x / (nrm + 1e-9)) AS u FROM vn),
cpos AS (SELECT cluster, unnest(range(1, len(u) + 1)) AS pos, unnest(u) AS x FROM u9),
cmean AS (SELECT cluster, list(m ORDER BY pos) AS mean FROM (SELECT cluster, pos, avg(x) AS m FROM cpos GROUP BY 1, 2) GROUP BY 1),
cn AS (SELECT cluster, mean, sqrt(list_sum(list_transform(mean, lambda y: y * y))) AS nrm FROM cmean),
cent AS (SELECT cluster, list_transform(mean, lambda x: x / (nrm + 1e-9)) AS c FROM cn),
sem AS (SELECT u9.url, {_dot('u9.u', 'cent.c')} AS sem FROM u9 JOIN cent USING (cluster)),
members AS (SELECT cluster, count(*)::DOUBLE AS m FROM tdocs GROUP BY 1),
mu AS (SELECT l.cluster, t.term, sum(t.w) / any_value(members.m) AS mu
       FROM tw t JOIN tdocs l USING (url) JOIN members USING (cluster) GROUP BY 1, 2),
tcen AS (SELECT cluster, term, mu / (sqrt(sum(mu * mu) OVER (PARTITION BY cluster)) + 1e-9) AS c FROM mu),
tdot AS (SELECT t.url, sum(t.w * tcen.c) AS tfs FROM tw t JOIN tdocs l USING (url)
         JOIN tcen ON tcen.cluster = l.cluster AND tcen.term = t.term GROUP BY 1),
csum AS (SELECT l.cluster, k.term, sum(k.w) AS score FROM dkw k JOIN tdocs l USING (url) GROUP BY 1, 2),
crank AS (SELECT * FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rk
          FROM csum) WHERE rk <= 15),
ckw AS (SELECT cluster, array_to_string(list(term ORDER BY rk), ', ') AS kw FROM crank GROUP BY 1),
scored AS (
  SELECT m.cluster, m.url, m.title, coalesce(p.pagerank, 0.0) AS pagerank, coalesce(s.sem, 0.0) AS sem,
         coalesce(t.tfs, 0.0) AS tfs, 0.6 * coalesce(s.sem, 0.0) + 0.4 * coalesce(t.tfs, 0.0) AS total,
         ({wc} >= 150 AND NOT (regexp_matches(lower(CAST(m.url AS VARCHAR)), {q(U.LISTING_CONTAINS_RE)})
            OR regexp_full_match(lower(CAST(m.url AS VARCHAR)), {q(U.LISTING_FULL_RE)}))) AS ok,
         substring(coalesce(coalesce(nullif(m.text, ''), m.title), ''), 1, 500) AS excerpt
  FROM tdocs m LEFT JOIN sem s USING (url) LEFT JOIN tdot t USING (url) LEFT JOIN pr_final p USING (url)
),
anyok AS (SELECT cluster, max(ok) AS any_ok FROM scored GROUP BY 1),
cand AS (SELECT s.* FROM scored s JOIN anyok USING (cluster) WHERE s.ok OR NOT anyok.any_ok),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total DESC, pagerank DESC, url DESC, title DESC) AS rn FROM cand)
SELECT b.cluster, b.url, b.title, round(b.pagerank, 6) AS pagerank, round(b.sem, 4) AS semantic_sim, round(b.tfs, 4) AS tfidf_sim,
       round(b.total, 4) AS total_sim, coalesce(ckw.kw, '') AS cluster_keywords, b.excerpt
FROM best b LEFT JOIN ckw USING (cluster) WHERE rn = 1"""


# ------------------------------------------------------------------ H

from linkloom.operators import reports as RP  # noqa: E402

REPORT_NODES = f"""
{users_rule('art', FX.ARTICLE_RULE)},
rnodes AS (
  SELECT c.url, split_part(d.text, chr(10), 1) AS title, (a.url IS NOT NULL) AS is_article,
         e.label AS cluster
  FROM cnodes c LEFT JOIN art a USING (url) LEFT JOIN embeddings e ON e.vec_id = c.url
  LEFT JOIN documents d ON d.doc_id = c.url
)"""

LABELED_KW = f"""{tfidf_ctes(LABELED_DOCS)},
csum AS (SELECT l.cluster, k.term, sum(k.w) AS score FROM dkw k JOIN tdocs l USING (url) GROUP BY 1, 2),
crank AS (SELECT * FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, term) AS rk
          FROM csum) WHERE rk <= 15),
ckw AS (SELECT cluster, array_to_string(list(term ORDER BY rk), ', ') AS kw FROM crank GROUP BY 1)"""

PAGE_EDGES = f"""{LINKS},
internal AS (SELECT * FROM resolved WHERE {INTERNAL}),
pgrp AS (SELECT src AS source, href AS target, count(*) AS weight, list(anchor ORDER BY pos)[1:50] AS anchors
         FROM internal GROUP BY 1, 2)"""


def _anchor_str(expr: str, sep: str, take: int | None = None, limit: int | None = 2000) -> str:
    s = f"list_sort(list_distinct(list_filter({expr}, lambda x: x <> '')))"
    if take:
        s = f"{s}[1:{take}]"
    s = f"array_to_string({s}, {q(sep)})"
    return f"substring({s}, 1, {limit})" if limit else s


@oracle("overview")
def _():
    return f"""WITH {click_ctes()}, {REPORT_NODES}
SELECT (SELECT count(*) FROM rnodes) AS total_pages, (SELECT count(*) FROM cedges) AS internal_links,
       (SELECT count(*) FROM rnodes WHERE is_article) AS article_pages,
       (SELECT count(DISTINCT cluster) FROM rnodes WHERE is_article) AS topic_clusters"""


@oracle("cluster_distribution")
def _():
    return f"""WITH {click_ctes()}, {REPORT_NODES}, {LABELED_KW}
SELECT n.cluster, count(*) AS count, coalesce(min(ckw.kw), '') AS keywords
FROM rnodes n LEFT JOIN ckw USING (cluster) WHERE n.is_article AND n.cluster IS NOT NULL GROUP BY n.cluster"""


@oracle("authority_top25")
def _():
    return f"""WITH {click_ctes()}, {REPORT_NODES}, {pagerank_sql('cnodes', 'cedges', 100, 1e-6)},
r AS (SELECT p.url, p.pagerank, n.cluster, row_number() OVER (ORDER BY p.pagerank DESC, p.url) AS rank
      FROM pr_final p LEFT JOIN rnodes n USING (url))
SELECT url, round(pagerank, 6) AS pagerank, cluster, rank FROM r WHERE rank <= 25"""


@oracle("edges_head")
def _():
    return f"WITH {click_ctes()} SELECT source, target, weight FROM cedges ORDER BY source, target LIMIT 200"


@oracle("priority_bands")
def _():
    inner = _recommend(0.25)
    return f"""SELECT CASE WHEN similarity > 0.7 THEN 'high' WHEN similarity >= 0.5 THEN 'medium' ELSE 'low' END AS band,
       count(*) AS n FROM ({inner}) GROUP BY 1"""


@oracle("anchor_search")
def _():
    return f"""WITH {PAGE_EDGES},
ex AS (SELECT source, target, weight, coalesce({_anchor_str('anchors', ' | ')}, '') AS anchors FROM pgrp)
SELECT * FROM ex WHERE regexp_matches(coalesce(anchors, ''), '(?i)the')"""


@oracle("anchor_index_search")
def _():
    return f"""WITH {PAGE_EDGES},
ex AS (SELECT source, target, weight, coalesce({_anchor_str('anchors', ' | ')}, '') AS anchors FROM pgrp)
SELECT * FROM ex WHERE regexp_matches(coalesce(anchors, ''), '(?i){FX.ANCHOR_PATTERN}')"""


@oracle("anchor_search_count")
def _():
    return f"""WITH {PAGE_EDGES},
ex AS (SELECT coalesce({_anchor_str('anchors', ' | ')}, '') AS anchors FROM pgrp)
SELECT count(*) AS matches FROM ex WHERE regexp_matches(anchors, '(?i)the')"""


@oracle("weight_bound")
def _():
    return f"WITH {click_ctes()} SELECT max(weight) AS max_weight FROM cedges"


@oracle("filtered_graph")
def _():
    return f"""WITH {click_ctes()}, {REPORT_NODES},
nf AS (SELECT * FROM rnodes WHERE is_article AND cluster IN (0, 1, 2, 3, 4))
SELECT e.source, e.target, e.weight FROM cedges e JOIN nf s ON s.url = e.source JOIN nf t ON t.url = e.target
WHERE coalesce(e.weight, 1) >= 2 AND s.cluster = t.cluster"""


@oracle("node_style")
def _():
    pal = "[" + ", ".join(q(c) for c in RP.PALETTE) + "]"
    return f"""WITH {click_ctes()}, {REPORT_NODES}, {pagerank_sql('cnodes', 'cedges', 100, 1e-6)},
j AS (SELECT n.url, n.cluster, coalesce(p.pagerank, 0.0) AS pr FROM rnodes n LEFT JOIN pr_final p USING (url)),
rng AS (SELECT min(pr) AS lo, max(pr) AS hi FROM j)
SELECT url, round(15.0 + 25.0 * (pr - lo) / (CASE WHEN hi - lo > 1e-12 THEN hi - lo ELSE 1.0 END), 6) AS size,
       CASE WHEN cluster IS NULL THEN {q(RP.NO_CLUSTER_COLOR)} ELSE {pal}[(cluster % 20) + 1] END AS color
FROM j CROSS JOIN rng"""


LAYOUT = """lay AS (SELECT vec_id AS url, label AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
lrng AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lay),
pix AS (SELECT url, cluster,
               (x - (x0 + (x1 - x0 + 1e-6) / 2.0)) * (900.0 / greatest(x1 - x0 + 1e-6, y1 - y0 + 1e-6)) AS px,
               -(y - (y0 + (y1 - y0 + 1e-6) / 2.0)) * (900.0 / greatest(x1 - x0 + 1e-6, y1 - y0 + 1e-6)) AS py
        FROM lay CROSS JOIN lrng)"""


@oracle("pixel_layout")
def _():
    return f"WITH {LAYOUT} SELECT url, cluster, round(px, 6) AS px, round(py, 6) AS py FROM pix"


@oracle("cluster_centers")
def _():
    return f"""WITH {LAYOUT}, {LABELED_KW}
SELECT p.cluster, round(avg(px), 6) AS cx, round(avg(py), 6) AS cy, coalesce(any_value(ckw.kw), '') AS label
FROM pix p LEFT JOIN ckw USING (cluster) GROUP BY p.cluster"""


@oracle("node_labels")
def _():
    return f"""WITH {tfidf_ctes(LABELED_DOCS)},
members AS (SELECT cluster, count(*)::DOUBLE AS m FROM tdocs GROUP BY 1),
mu AS (SELECT l.cluster, t.term, sum(t.w) / any_value(members.m) AS mu
       FROM tw t JOIN tdocs l USING (url) JOIN members USING (cluster) GROUP BY 1, 2),
cen AS (SELECT cluster, term, mu / (sqrt(sum(mu * mu) OVER (PARTITION BY cluster)) + 1e-9) AS c FROM mu),
dots AS (SELECT t.url, sum(t.w * cen.c) AS sim FROM tw t JOIN tdocs l USING (url)
         JOIN cen ON cen.cluster = l.cluster AND cen.term = t.term GROUP BY 1),
n AS (SELECT l.url, l.cluster, split_part(l.text, chr(10), 1) AS title, coalesce(dots.sim, 0.0) AS ps
      FROM tdocs l LEFT JOIN dots USING (url)),
parts AS (SELECT url, title, concat_ws('<br/>',
            CASE WHEN coalesce(title, '') <> '' THEN '<b>Title</b>: ' || title END,
            CASE WHEN cluster IS NOT NULL THEN '<b>Cluster</b>: ' || CAST(cluster AS VARCHAR) END,
            CASE WHEN ps IS NOT NULL THEN '<b>Pillar sim</b>: ' || printf('%.3f', ps) END) AS tip FROM n)
SELECT url,
       CASE WHEN length(coalesce(title, '')) > 40 THEN substring(title, 1, 40) || '…'
            WHEN coalesce(title, '') <> '' THEN title ELSE CAST(url AS VARCHAR) END AS label,
       CASE WHEN tip = '' THEN CAST(url AS VARCHAR) ELSE tip END AS tooltip
FROM parts"""


@oracle("edge_tooltips")
def _():
    return f"WITH {PAGE_EDGES} SELECT source, target, {_anchor_str('anchors', '<br/>', take=20, limit=None)} AS tooltip FROM pgrp"


@oracle("low_degree")
def _():
    return f"WITH {click_ctes()}, {degree_sql('cnodes', 'cedges')} SELECT url, in_degree, out_degree FROM deg_final WHERE in_degree <= 10.0"


@oracle("low_relevance")
def _():
    return f"""WITH {tfidf_ctes(LABELED_DOCS)},
members AS (SELECT cluster, count(*)::DOUBLE AS m FROM tdocs GROUP BY 1),
mu AS (SELECT l.cluster, t.term, sum(t.w) / any_value(members.m) AS mu
       FROM tw t JOIN tdocs l USING (url) JOIN members USING (cluster) GROUP BY 1, 2),
cen AS (SELECT cluster, term, mu / (sqrt(sum(mu * mu) OVER (PARTITION BY cluster)) + 1e-9) AS c FROM mu),
dots AS (SELECT t.url, sum(t.w * cen.c) AS sim FROM tw t JOIN tdocs l USING (url)
         JOIN cen ON cen.cluster = l.cluster AND cen.term = t.term GROUP BY 1),
n AS (SELECT l.url, coalesce(dots.sim, 0.0) AS ps FROM tdocs l LEFT JOIN dots USING (url))
SELECT url, round(ps, 6) AS pillar_sim FROM n ORDER BY ps, url LIMIT 10"""


@oracle("cluster_link_share")
def _():
    return f"""WITH {click_ctes()}, {REPORT_NODES},
j AS (SELECT s.cluster AS cs, t.cluster AS ct FROM cedges e JOIN rnodes s ON s.url = e.source JOIN rnodes t ON t.url = e.target
      WHERE s.cluster IS NOT NULL AND t.cluster IS NOT NULL)
SELECT sum(CASE WHEN cs = ct THEN 1 ELSE 0 END)::BIGINT AS within_links,
       count(*) - sum(CASE WHEN cs = ct THEN 1 ELSE 0 END)::BIGINT AS cross_links, count(*) AS total_links,
       round(sum(CASE WHEN cs = ct THEN 1 ELSE 0 END) / count(*), 6) AS within_share FROM j"""


@oracle("snapshot_diff")
def _():
    return f"""WITH {click_ctes()}, {users_rule('crawled', FX.CRAWLED_RULE)},
a AS (SELECT n.url, coalesce(i.c, 0)::DOUBLE AS in_degree FROM cnodes n
      LEFT JOIN (SELECT target AS url, count(*) AS c FROM (SELECT DISTINCT source, target FROM cedges) GROUP BY 1) i USING (url)),
bedges AS (SELECT DISTINCT user_id AS source, nxt AS target FROM clicks WHERE nxt IS NOT NULL AND nxt IN (SELECT url FROM crawled)),
b AS (SELECT n.url, coalesce(i.c, 0)::DOUBLE AS in_degree FROM cnodes n
      LEFT JOIN (SELECT target AS url, count(*) AS c FROM bedges GROUP BY 1) i USING (url))
SELECT coalesce(a.url, b.url) AS url, a.in_degree AS in_degree_a, b.in_degree AS in_degree_b,
       coalesce(b.in_degree, 0.0) - coalesce(a.in_degree, 0.0) AS delta
FROM a FULL OUTER JOIN b USING (url)"""


# ------------------------------------------------------------------ C

def frontier_sql(max_depth: int, max_pages: int, prefix: str | None) -> str:
    parts = [f"{users_rule('seeds', FX.SEED_RULE)}",
             "f0 AS MATERIALIZED (SELECT url, 0 AS depth FROM seeds WHERE url IN (SELECT url FROM cnodes))"]
    seen = ["f0"]
    for dd in range(1, max_depth + 1):
        cond = f"AND (starts_with(CAST(e.target AS VARCHAR), {q(prefix)}) OR f.depth < 1)" if prefix else ""
        union = " UNION ALL ".join(f"SELECT url FROM {x}" for x in seen)
        parts.append(f"""f{dd} AS MATERIALIZED (
  SELECT DISTINCT e.target AS url, {dd} AS depth FROM f{dd-1} f JOIN cedges e ON e.source = f.url
  WHERE e.target NOT IN ({union}) AND e.target IN (SELECT url FROM cnodes) {cond}
    AND (SELECT count(*) FROM ({union})) < {max_pages}
)""")
        seen.append(f"f{dd}")
    allv = " UNION ALL ".join(f"SELECT url, depth FROM {x}" for x in seen)
    parts.append(f"fr AS (SELECT url, depth, row_number() OVER (ORDER BY depth, url) AS rk FROM ({allv}))")
    return ",\n".join(parts)


@oracle("frontier_depths")
def _():
    return f"WITH {click_ctes()}, {frontier_sql(2, 100, None)} SELECT url, depth FROM fr WHERE rk <= 100"


@oracle("frontier_focus")
def _():
    return f"WITH {click_ctes()}, {frontier_sql(3, 1000, '1')} SELECT url, depth FROM fr WHERE rk <= 1000"


# ------------------------------------------------------------------ A

@oracle("sitemap_urls")
def _():
    return f"""WITH p AS (SELECT {SITE_DOMAIN} AS site, url, page_id FROM pages)
SELECT 'https://' || site || '/sitemap.xml' AS root, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS pos
FROM p"""


# ------------------------------------------------------------------ K5, H7, B12

@oracle("article_keywords")
def _():
    return f"""WITH {tfidf_ctes(LABELED_DOCS)}
SELECT l.url, split_part(l.text, chr(10), 1) AS title, l.cluster,
       array_to_string(list(k.term ORDER BY k.rk), '; ') AS keywords_top
FROM tdocs l JOIN dkw k USING (url) GROUP BY l.url, l.text, l.cluster"""


@oracle("keywords_head")
def _():
    return f"""WITH {tfidf_ctes(LANG_DOCS)},
k AS (SELECT site, url, array_to_string(list(term ORDER BY rk), '; ') AS keywords FROM dkw GROUP BY site, url)
SELECT url, keywords FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY url) AS rn FROM k) WHERE rn <= 50"""


@oracle("recs_head")
def _():
    return f"SELECT source_url, target_url, similarity FROM ({_recommend(0.25)}) ORDER BY source_url, similarity DESC, target_url LIMIT 100"


@oracle("title_flags")
def _():
    t = f"lower(coalesce({title('html')}, ''))"
    conds = " AND ".join(f"NOT contains({t}, {q(w)})" for w in U.DEFAULT_TITLE_EXCLUDE)
    return f"SELECT url, (length({t}) >= {U.DEFAULT_MIN_TITLE_LENGTH} AND {conds}) AS title_ok FROM pages"


# ------------------------------------------------------------------ A7, A8, C2, D1, D7, D8

@oracle("sitemap_prefix_cap")
def _():
    return f"""WITH p AS (SELECT {SITE_DOMAIN} AS site, url, page_id, page_id // 100 AS chunk FROM pages WHERE starts_with(url, 'https://')),
r AS (SELECT *, row_number() OVER (PARTITION BY site, chunk ORDER BY page_id) AS pos FROM p)
SELECT 'https://' || site || '/sitemap-' || chunk || '.xml' AS doc, url, pos FROM r WHERE pos <= 20"""


@oracle("crawl_seeds")
def _():
    return f"""WITH p AS (SELECT {SITE_DOMAIN} AS site, url, page_id FROM pages),
every AS (SELECT site, url, 0 AS grp, page_id AS pos FROM p
          UNION ALL SELECT site, arg_min(url, page_id), 1, 0 FROM p GROUP BY site)
SELECT site, url, min(grp) AS grp, arg_min(pos, struct_pack(g := grp, p := pos)) AS pos FROM every GROUP BY site, url"""


@oracle("attached_nodes")
def _():
    return f"""SELECT p.url, {title('html')} AS title, {_is_article_sql('p.url')} AS is_article, e.label AS cluster
FROM pages p LEFT JOIN embeddings e ON e.vec_id = p.page_id"""


@oracle("weighted_degrees")
def _():
    return f"WITH {click_ctes()} SELECT source AS url, sum(CASE WHEN weight > 1 THEN 1 ELSE weight END) AS out_weight FROM cedges GROUP BY 1"


# ------------------------------------------------------------------ C3, K, H23

def queue_sql(seed_order: str, stored: str, max_depth: int, max_pages: int, focus: str | None = None) -> str:
    """The queue step by step: one row of a recursive query per entry taken."""
    follow = "" if focus is None else f" AND (d = 0 OR starts_with(h::VARCHAR, {q(focus)}))"
    return f"""adj AS (SELECT user_id AS src, list(nxt ORDER BY event_id) AS hs
        FROM (SELECT user_id, event_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'click')
        WHERE nxt IS NOT NULL GROUP BY 1),
first AS (SELECT coalesce(list(struct_pack(u := url, d := 0) ORDER BY {seed_order}), []) AS q FROM seeds),
run(step, queue, visited, pages) AS (
  SELECT 0, q, []::BIGINT[], []::STRUCT(u BIGINT, d INTEGER)[] FROM first
  UNION ALL
  SELECT step + 1,
    CASE WHEN page THEN queue[2:] || list_transform(
           list_filter(coalesce(hs, []), lambda h: h <> u AND NOT list_contains(visited, h){follow})[:greatest(0, {max_pages} - len(pages) - len(queue))],
           lambda h: struct_pack(u := h, d := d + 1)) ELSE queue[2:] END,
    CASE WHEN fresh THEN list_append(visited, u) ELSE visited END,
    CASE WHEN page THEN list_append(pages, struct_pack(u := u, d := d)) ELSE pages END
  FROM (SELECT r.*, r.queue[1].u AS u, r.queue[1].d AS d, a.hs,
               NOT list_contains(r.visited, r.queue[1].u) AND r.queue[1].d <= {max_depth} AS fresh,
               NOT list_contains(r.visited, r.queue[1].u) AND r.queue[1].d <= {max_depth} AND s.url IS NOT NULL AS page
        FROM run r LEFT JOIN adj a ON a.src = r.queue[1].u LEFT JOIN {stored} s ON s.url = r.queue[1].u
        WHERE len(r.queue) > 0 AND len(r.pages) < {max_pages})),
done AS (SELECT unnest(pages) AS p, generate_subscripts(pages, 1) AS no FROM (SELECT pages FROM run ORDER BY step DESC LIMIT 1))"""


@oracle("crawl_order")
def _():
    return f"""WITH RECURSIVE {users_rule('seeds', FX.SEED_RULE)}, {users_rule('crawled', FX.CRAWLED_RULE)},
{queue_sql('url', 'crawled', 3, 100)} SELECT p.u AS url, p.d AS depth, no FROM done"""


@oracle("crawl_order_focus")
def _():
    return f"""WITH RECURSIVE {click_ctes()}, {users_rule('seeds', FX.SEED_RULE)},
{queue_sql('url DESC', 'cnodes', 3, 40, '1')} SELECT p.u AS url, p.d AS depth, no FROM done"""


TWO_RUNS = f"""v AS (SELECT vec_id AS url, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ra AS (SELECT url, label AS c FROM v WHERE e[9] <= {FX.RUN_LIMIT}),
rb AS (SELECT url, list_position(e[1:8], list_max(e[1:8])) AS c FROM v WHERE e[10] <= {FX.RUN_LIMIT})"""


def matching_sql(n: int = 10) -> str:
    """Best assignment by trial over sets of taken clusters: one step per cluster of the first run, the best way to each set kept."""
    out = [f"""{TWO_RUNS},
olds AS (SELECT c, row_number() OVER (ORDER BY c) AS i, count(*) AS size FROM ra GROUP BY c),
news AS (SELECT c, row_number() OVER (ORDER BY c) AS j, count(*) AS size FROM rb GROUP BY c),
share AS MATERIALIZED (SELECT o.i, w.j, count(*) AS n FROM ra JOIN rb USING (url) JOIN olds o ON o.c = ra.c JOIN news w ON w.c = rb.c GROUP BY 1, 2),
s0 AS (SELECT 0 AS mask, 0 AS lost, []::BIGINT[] AS picks)"""]
    for i in range(1, n + 1):
        out.append(f"""s{i} AS MATERIALIZED (SELECT mask, best.lost AS lost, best.picks AS picks FROM (
  SELECT mask, min(struct_pack(lost := lost, picks := picks)) AS best FROM (
    SELECT mask, lost, list_append(picks, 999) AS picks FROM s{i - 1}
    UNION ALL
    SELECT mask | (1 << h.j::INT), lost - h.n, list_append(picks, h.j) FROM s{i - 1} JOIN share h ON h.i = {i} AND mask & (1 << h.j::INT) = 0)
  GROUP BY mask))""")
    out.append(f"""win AS (SELECT picks FROM s{n} ORDER BY lost, picks LIMIT 1),
pick AS (SELECT o.c AS ca, o.size AS sa, w.c AS cb, w.size AS sb, coalesce(h.n, 0) AS n
  FROM olds o, win LEFT JOIN news w ON w.j = picks[o.i] LEFT JOIN share h ON h.i = o.i AND h.j = w.j)""")
    return ",\n".join(out)


@oracle("cluster_matches")
def _():
    return f"""WITH {matching_sql()}
SELECT ca AS cluster_before, coalesce(cb, -1) AS cluster_after, n AS shared, sa AS size_before, coalesce(sb, -1) AS size_after FROM pick
UNION ALL SELECT -1, c, 0, -1, size FROM news WHERE c NOT IN (SELECT cb FROM pick WHERE cb IS NOT NULL)"""


@oracle("cluster_shifts")
def _():
    return f"""WITH {matching_sql()}
SELECT coalesce(a.url, b.url) AS url, coalesce(a.c, -1) AS cluster_before, coalesce(b.c, -1) AS cluster_after, coalesce(p.cb, -1) AS expected,
       CASE WHEN a.c IS NULL THEN 'added' WHEN b.c IS NULL THEN 'removed' WHEN b.c = p.cb THEN 'stayed' ELSE 'moved' END AS status
FROM ra a FULL JOIN rb b ON a.url = b.url LEFT JOIN pick p ON p.ca = a.c"""


@oracle("run_comparison")
def _():
    return f"""WITH {click_ctes()}, {users_rule('crawled', FX.CRAWLED_RULE)},
early AS (SELECT DISTINCT user_id AS source, nxt AS target FROM clicks WHERE nxt IS NOT NULL AND nxt IN (SELECT url FROM crawled)),
na AS (SELECT url FROM cnodes WHERE url IN (SELECT url FROM crawled)),
a AS (SELECT url, (SELECT count(*) FROM early WHERE target = url)::DOUBLE AS i, (SELECT count(*) FROM early WHERE source = url)::DOUBLE AS o FROM na),
b AS (SELECT url, (SELECT count(*) FROM cedges WHERE target = url)::DOUBLE AS i, (SELECT count(*) FROM cedges WHERE source = url)::DOUBLE AS o FROM cnodes)
SELECT b.url, CASE WHEN a.url IS NULL THEN 'added' ELSE 'kept' END AS status, a.i AS in_degree_before, b.i AS in_degree_after,
       b.i - coalesce(a.i, 0) AS in_degree_change, a.o AS out_degree_before, b.o AS out_degree_after, b.o - coalesce(a.o, 0) AS out_degree_change
FROM b LEFT JOIN a USING (url)"""


# ------------------------------------------------------------------ B4 by blocks, E4 by sketches

@oracle("main_text")
def _():
    from linkloom.operators.boilerplate import BLOCK_RE, LEFT_OUT_RES
    from linkloom.plans import sqlgen as Q

    page = "html"
    for pattern in (*H.HIDDEN_RES, *LEFT_OUT_RES):
        page = rx_replace(page, pattern, " ")

    def plain(e):
        return f"trim({rx_replace(Q.unescape(rx_replace(e, H.TAG_RE, ' ')), Q.WS_RE, ' ')})"

    anchors = f"regexp_extract_all(raw, {q(Q.ANCHOR_ELEM_RE)})"
    return f"""WITH p AS (SELECT {Q.host('url')} AS site, url, regexp_split_to_array({page}, {q(BLOCK_RE)}) AS parts FROM pages),
r AS (SELECT site, url, generate_subscripts(parts, 1) AS pos, unnest(parts) AS raw FROM p),
b AS (SELECT site, url, pos, {plain('raw')} AS text,
             coalesce(list_sum(list_transform({anchors}, lambda a: length({plain("a")}))), 0) AS link_chars FROM r),
full_b AS (SELECT *, link_chars > 0.5 * length(text) AS mostly FROM b WHERE text <> ''),
sizes AS (SELECT site, count(DISTINCT url) AS n FROM p GROUP BY site),
often AS (SELECT o.site, o.text FROM (SELECT site, text, count(DISTINCT url) AS c FROM full_b GROUP BY 1, 2) o JOIN sizes s ON s.site = o.site
          WHERE o.c >= 2 AND o.c >= s.n * 0.2),
j AS (SELECT f.*, NOT mostly AND o.text IS NULL AS stays FROM full_b f LEFT JOIN often o ON o.site = f.site AND o.text = f.text)
SELECT p.url, count(j.pos) AS n_blocks, count(*) FILTER (WHERE stays) AS kept_blocks,
       sha256(coalesce(string_agg(j.text, ' ' ORDER BY j.pos) FILTER (WHERE stays), '')) AS text_sha
FROM p LEFT JOIN j ON j.url = p.url GROUP BY p.url"""


@oracle("closeness_sketch")
def _():
    return f"WITH {click_ctes()} SELECT url, TRUE AS ok FROM cnodes"


# ------------------------------------------------------------------ B6, B7 by rules; G2 and F9 as values

@oracle("suffix_domains")
def _():
    rules = ", ".join(f"({q(r.lstrip('!'))}, {str(r.startswith('!')).lower()})" for r in FX.SUFFIX_RULES if not r.startswith("//"))
    return f"""WITH rules(pattern, exception) AS (VALUES {rules}),
h AS (SELECT DISTINCT {_host('url')} AS host FROM pages),
m AS (SELECT host, max(struct_pack(e := exception, n := len(string_split(pattern, '.')))) AS b FROM h JOIN rules
      ON ('.' || host) LIKE '%.' || replace(pattern, '*.', '') AND len(string_split(host, '.')) >= len(string_split(pattern, '.')) GROUP BY host),
s AS (SELECT h.host, string_split(h.host, '.') AS l, coalesce(b.n - b.e::INT, 1) + 1 AS k FROM h LEFT JOIN m ON m.host = h.host)
SELECT p.url, array_to_string(l[greatest(1, len(l) - k + 1):], '.') AS domain FROM pages p JOIN s ON s.host = {_host('p.url')}"""


@oracle("kmeans_nearest")
def _():
    return "SELECT vec_id AS url, TRUE AS ok FROM embeddings"


@oracle("svd_first")
def _():
    """Power iteration on the documents' inner products; weights have no negative entries, so the first gap is wide."""
    steps = ["x0 AS (SELECT url, 1.0::DOUBLE AS x FROM (SELECT DISTINCT url FROM tw))"]
    rounds = 40
    for i in range(rounds):
        steps.append(f"y{i} AS MATERIALIZED (SELECT g.a AS url, sum(g.dot * x.x) AS y FROM gram g JOIN x{i} x ON x.url = g.b GROUP BY g.a)")
        steps.append(f"x{i + 1} AS MATERIALIZED (SELECT url, y / sqrt(sum(y * y) OVER ()) AS x FROM y{i})")
    return f"""WITH {tfidf_ctes(LABELED_DOCS, 10000)},
gram AS MATERIALIZED (SELECT p.url AS a, r.url AS b, sum(p.w * r.w) AS dot FROM tw p JOIN tw r ON p.term = r.term GROUP BY 1, 2),
{", ".join(steps)},
sigma AS (SELECT sqrt(sqrt(sum(y * y))) AS s FROM y{rounds - 1})
SELECT url, round(abs(x) * s, 3) AS first FROM x{rounds}, sigma"""


# ------------------------------------------------------------------ F11 and G3 as values

@oracle("hybrid_dense_part")
def _():
    return f"""WITH {tfidf_ctes(LABELED_DOCS, 10000)},
v AS (SELECT vec_id AS url, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT url, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v)
SELECT url, round(sqrt(0.5) * e[1] / (size + 1e-10), 5) AS first, round(sqrt(0.5) * e[len(e)] / (size + 1e-10), 5) AS last, 1.0::DOUBLE AS norm
FROM n WHERE url IN (SELECT url FROM tw)"""


@oracle("recluster_override")
def _():
    return "SELECT coalesce(doc_id, vec_id) AS url, vec_id IS NOT NULL AS labelled FROM documents FULL JOIN embeddings ON doc_id = vec_id"
