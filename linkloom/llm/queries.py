"""Registered queries of the training-data operators and their DuckDB SQL.

Each applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (alignment, bloom_lm, caps, content_sort, licenses, minhash, mixing, packing, quality, surrogates, toxicity, url_rules,
                          vector_codes)
from linkloom.session import table


# The queries' key; a deployment passes its own secret to surrogates.replace.
SURROGATE_KEY = b"registered query"

# Fixed values of the contract: host, path, verdict.
SITE_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(col: str = "doc_id"):
    """crc32 of the identifier as text, modulo 5: the folds that the contracts name."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op2_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(remainder() != 0))
    return toxicity.score(docs.withColumn("held_out", remainder() == 0), model, keep=("held_out",))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    net = quality.fit(docs, labels.filter(remainder() != 0))
    return quality.score(docs.withColumn("held_out", remainder() == 0), net, keep=("held_out",))


def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = bloom_lm.fit(docs.filter(remainder() != 1))
    return bloom_lm.score(docs.withColumn("held_out", remainder() == 1), model, keep=("held_out",))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), SITE_RULES)


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort(table(spark, sf_dir, "documents"))


def op11_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_surrogates, op2_toxic_passages, op3_minhash_near_dedup, op4_attention_quality, op5_spherical_caps, op6_pack_sequences,
                                 op7_bloom_lm, op8_mix_sources, op9_url_rules, op10_content_sort, op11_pair_bitmaps, op12_resident_lloyd,
                                 op13_license_index)}



def lloyd_sql(positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds of operator 12, one after the other."""
    out = [f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS part, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT part, vec_id, p.pos, q[p.pos * len(q) // {positions} + 1:(p.pos + 1) * len(q) // {positions}] AS v
  FROM kept, (SELECT unnest(range(0, {positions})) AS pos) p),
book0 AS MATERIALIZED (SELECT pos, part - 1 AS entry, v FROM x WHERE part <= {entries})"""]
    for r in range(rounds + 1):
        out.append(f"""far{r} AS MATERIALIZED (
  SELECT x.part, x.pos, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.entry)) AS best
  FROM x JOIN book{r} b ON x.pos = b.pos GROUP BY x.part, x.pos)""")
        if r < rounds:
            out.append(f"""mean{r} AS MATERIALIZED (
  SELECT pos, entry, list(m ORDER BY i) AS v FROM (
    SELECT x.pos, f.best.e AS entry, i, floor(sum(x.v[i])::DOUBLE / count(*))::BIGINT AS m
    FROM x JOIN far{r} f ON x.part = f.part AND x.pos = f.pos, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS i) GROUP BY ALL) GROUP BY pos, entry),
book{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON b.pos = m.pos AND b.entry = m.entry)""")
    out.append(f"""books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, entry)) AS h FROM book{rounds}),
coded AS (SELECT part, string_agg(lower(printf('%02x', best.e)), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM far{rounds} GROUP BY part)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept k JOIN coded c ON c.part = k.part, books""")
    return out[0] + ",\n" + ",\n".join(out[1:])


ORACLE = {
    "op12_resident_lloyd": lloyd_sql(),
    "op3_minhash_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s
  FROM w WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edge AS MATERIALIZED (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, edge.v FROM reach JOIN edge ON reach.b = edge.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op5_spherical_caps": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.v FROM reach JOIN link ON reach.b = link.u)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT u, count(*) AS n FROM link GROUP BY u) l ON l.u = e.vec_id""",
    "op8_mix_sources": """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
-- the level at which shares are cut: sources are full in order of words per weight
steps AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 3 * source_size / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM per),
lev AS (SELECT max((total - full_before) / weight_left) FILTER (WHERE 3 * source_size / weight >= (total - full_before) / weight_left) AS level FROM steps),
budget AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target,
         CASE WHEN source_size > 0 THEN floor(least((3 * source_size)::DOUBLE, weight * level) / source_size) ELSE 0 END AS whole
  FROM per, lev),
by_hash AS (
  SELECT source, h, sum(size) AS words,
         coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized GROUP BY source, h),
extra AS (
  SELECT b.source, b.h, b.before + b.words <= g.target - g.whole * g.source_size
         OR (b.before <= g.target - g.whole * g.source_size AND b.words <= 2 * (g.target - g.whole * g.source_size - b.before)) AS more
  FROM by_hash b JOIN budget g ON b.source IS NOT DISTINCT FROM g.source)
SELECT s.doc_id, s.source, s.size::BIGINT AS size, g.source_size, g.target,
       (g.whole + CASE WHEN e.more THEN 1 ELSE 0 END)::BIGINT AS repeats,
       ((g.whole + CASE WHEN e.more THEN 1 ELSE 0 END) * s.size)::BIGINT AS taken
FROM sized s JOIN budget g ON s.source IS NOT DISTINCT FROM g.source
JOIN extra e ON s.source IS NOT DISTINCT FROM e.source AND s.h = e.h""",
    "op10_content_sort": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""",
}
