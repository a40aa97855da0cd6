"""Operator 9, URL filters from mined association rules.

A URL becomes a set of tokens (scheme, each domain suffix of its host, path
parts, file ending, query names, fragment; digit runs read as ``#``).  Spark's FP-growth
mines the token sets of labelled URLs together with their label; the rules
"tokens -> label" that have enough support and confidence stay, unless a rule
with fewer of the same tokens is at least as sure of the same label.  Each rule
is posted under its rarest token; a URL meets the rules posted under its own
tokens, those wholly contained in it vote, and the surest one (then the best
supported, the longest, the first in text order) decides.

Tokens that stand in the same labelled URLs (equal counts and sums of row hashes) are one item
to FP-growth, named by the last of them: any rule over several of them says no more than the
rule over one, so none is lost, and a long URL is one item instead of all subsets of its parts.
A URL has an item if it has one of its tokens.

Fixed site rules (host, path, verdict) come first: a rule fits its host and all
subdomains where the path starts with the rule's, the longest rule wins, and they
also label the URLs that FP-growth learns from.

Defined cases: a null URL or one without ``://`` has empty host and path and no
tokens; it and any URL without a mined rule get ``default``; without labelled URLs
nothing is mined; repeated and null identifiers are kept row by row; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.content_sort import ascii_lower
from linkloom.operators.iterate import cut
from linkloom.operators.joins import join_side_table

LABEL = "verdict="


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def site_rule(host: Column, path: Column, rules: list) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, as an array."""
    text = F.coalesce(url, F.lit(""))

    def plain(x):
        return F.regexp_replace(F.lower(x), r"\d+", "#")

    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("host:"), plain(F.array_join(F.slice(labels, i, n - i + 1), "."))))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), plain(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                        lambda x: F.concat(F.lit("query:"), plain(F.substring_index(x, "=", 1))))
    single = F.filter(F.array(
        F.concat(F.lit("scheme:"), F.lower(F.substring_index(text, "://", 1))),
        F.when(ending != "", F.concat(F.lit("ending:"), F.lower(ending))),
        F.when(text.contains("#"), F.lit("fragment:"))), lambda x: x.isNotNull())
    every = F.array_distinct(F.concat(suffixes, parts, names, single))
    return F.when(text.contains("://"), every).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules (items, label, confidence, support) from rows (items, verdict)."""
    baskets = labelled.select(F.concat("items", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith(LABEL)).filter(
        ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rules = cut(rules.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("label"),
                             "confidence", "support"))
    # prune by the rules with one token less: if one is as sure, this one adds nothing
    shorter = rules.select(F.col("items").alias("general"), "label", F.col("confidence").alias("general_confidence"))
    less = rules.select("items", "label", "confidence", F.explode("items").alias("x")).withColumn("general", F.array_remove("items", F.col("x")))
    useless = less.join(shorter, ["general", "label"]).filter("general_confidence >= confidence").select("items", "label").distinct()
    return rules.join(useless, ["items", "label"], "left_anti")


def items_of(labelled: DataFrame) -> DataFrame:
    """(token, item, urls): the item that each token of the labelled URLs belongs to, and how many have it."""
    rows = labelled.select(F.monotonically_increasing_id().alias("no"), "items")
    at = cut(rows).select("no", F.explode("items").alias("token"))
    sums = [F.sum(F.pmod(F.xxhash64("no", F.lit(k)), F.lit((1 << 31) - 1))).alias(f"s{k}") for k in range(4)]
    same = cut(at.groupBy("token").agg(F.count(F.lit(1)).alias("urls"), *sums))
    key = ["urls", *(f"s{k}" for k in range(4))]
    return cut(same.join(same.groupBy(*key).agg(F.max("token").alias("item")), key).select("token", "item", "urls"))


def with_items(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (.., items, key) with the tokens replaced by their items, one row per distinct token set."""
    got = join_side_table(rows.select("key", F.explode("items").alias("token")), items.select("token", "item"), ["token"], spread_key="key")
    return got.groupBy("key").agg(F.collect_set("item").alias("items"))


def judge(pages: DataFrame, rules: list, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.002,
          min_confidence: float = 0.6, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (the deciding token set), confidence."""
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    fixed, verdict = site_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = cut(rows.select("page_id", "host", "path", fixed.alias("rule"), verdict.alias("verdict"),
                           tokens(F.col("url"), F.col("host"), F.col("path")).alias("items")))
    none = [F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence")]
    labelled = rows.filter(F.col("verdict").isNotNull())
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"), *none)
    key = F.sha2(F.array_join(F.array_sort("items"), " "), 256).alias("key")
    items = items_of(labelled)
    # URLs with the same tokens are mined and judged by one set of items
    known = labelled.filter(F.size("items") > 0).select(F.monotonically_increasing_id().alias("no"), "verdict", "items", key)
    sets = with_items(known.select("key", "items").dropDuplicates(["key"]), items)
    baskets = cut(join_side_table(known.select("no", "verdict", "key"), sets, ["key"], spread_key="no").select("verdict", "items"))
    mined = cut(mine(baskets, min_support, min_confidence)
                .withColumn("no", F.array_join("items", " ")))

    # inverted index: a rule is posted under the item that fewest labelled URLs have
    common = items.select(F.col("item").alias("token"), F.col("urls").alias("count")).distinct()
    spread = mined.select("no", "label", F.explode("items").alias("token")).join(common, "token")
    posts = mined.join(spread.groupBy("no", "label").agg(F.min_by("token", F.struct("count", "token")).alias("token")), ["no", "label"])

    open_rows = rows.filter(F.col("verdict").isNull() & (F.size("items") > 0)).select("page_id", "host", "path", "items", key)
    kinds = cut(with_items(open_rows.groupBy("key").agg(F.first("items").alias("items")), items))
    met = kinds.select("key", F.col("items").alias("own"), F.explode("items").alias("token")).join(posts, "token")
    met = met.filter(F.size(F.array_except("items", "own")) == 0)
    order = F.struct(F.col("confidence"), F.col("support"), F.size("items"), F.col("no"), F.col("label"))
    best = met.groupBy("key").agg(F.max(order).alias("best")).select(
        "key", F.col("best.label").alias("voted"), F.col("best.no").alias("mined"), F.col("best.confidence").alias("confidence"))
    # only pages that rules can decide meet them; the others would all share one key
    voted = join_side_table(open_rows.select("page_id", "host", "path", "key"), best, ["key"], how="left", spread_key="page_id").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("voted", F.lit(default)).alias("verdict"), "mined", "confidence")
    rest = rows.filter(F.col("verdict").isNotNull() | (F.size("items") == 0)).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"), *none)
    return rest.unionByName(voted)
