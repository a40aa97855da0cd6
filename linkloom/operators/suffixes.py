"""Registered domains by a table of public-suffix rules.

A rule is a suffix (``co.uk``), a wildcard (``*.ck``: any one label before ``ck``) or an exception to
a wildcard (``!www.ck``).  Of the rules that match a host's last labels an exception wins, otherwise the
longest; its labels (an exception's without the first) are the public suffix, and the registered domain
is one label more.  A host that no rule matches has its last label as suffix.

The match is a join: each distinct host offers its suffixes, as they are and with a wildcard for the
first label, to the rule table.  Hosts, not pages, take part, so a large site costs one row, and its
pages get the answer back from a side table whose size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import urls as U
from linkloom.operators.joins import join_side_table

IP_RE = r"^(\d{1,3}\.){3}\d{1,3}$|^\[.*\]$"


def rule_table(rules: DataFrame) -> DataFrame:
    """``rules(rule)`` -> (pattern, exception): lower case, without comments, blanks and the exceptions' mark."""
    text = F.lower(F.trim(F.col("rule")))
    return rules.select(text.alias("r")).filter((F.col("r") != "") & ~F.col("r").startswith("//")).select(
        F.regexp_replace("r", "^!", "").alias("pattern"), F.col("r").startswith("!").alias("exception")).distinct()


def offers(host: Column) -> Column:
    """ARRAY<STRUCT<pattern, n>>: the host's suffixes of n labels, and each with ``*`` for its first label."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    plain = F.transform(F.sequence(F.lit(1), size), lambda n: F.struct(F.array_join(F.slice(labels, size - n + 1, n), ".").alias("pattern"), n.alias("n")))
    # a wildcard stands for one label more than the rest of its rule
    wild = F.transform(F.filter(F.sequence(F.lit(1), size), lambda n: n > 1), lambda n: F.struct(
        F.concat(F.lit("*."), F.array_join(F.slice(labels, size - n + 2, n - 1), ".")).alias("pattern"), n.alias("n")))
    return F.concat(plain, wild)


def registered_domains(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``hosts(host)`` -> (host, suffix, domain), distinct; a host that is itself a suffix, an address or empty is its own domain."""
    hosts = hosts.select("host").filter("host IS NOT NULL").distinct()
    offered = hosts.filter((F.col("host") != "") & ~F.col("host").rlike(IP_RE)).select("host", F.explode(offers(F.col("host"))).alias("o"))
    met = join_side_table(offered.select("host", F.col("o.pattern").alias("pattern"), F.col("o.n").alias("n")), rule_table(rules), ["pattern"], spread_key="host")
    best = met.groupBy("host").agg(F.max(F.struct("exception", "n")).alias("b"))
    n = F.coalesce(F.col("b.n") - F.col("b.exception").cast("int"), F.lit(1))
    labels = F.split("host", r"\.")
    address = (F.col("host") == "") | F.col("host").rlike(IP_RE)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - k + 1), F.size(labels)), ".")
    return hosts.join(best, "host", "left").select("host", F.when(address, "").otherwise(last(n)).alias("suffix"),
                                                   F.when(address, F.col("host")).otherwise(last(n + 1)).alias("domain"))


def with_registered_domain(df: DataFrame, rules: DataFrame, url_col: str = "url", out: str = "domain") -> DataFrame:
    """``df`` with the registered domain of ``url_col`` ('' for relative and null URLs)."""
    key = F.coalesce(U.url_host(F.col(url_col)), F.lit(""))
    rows = df.withColumn("_host", key)
    found = registered_domains(rows.select(F.col("_host").alias("host")), rules).select(F.col("host").alias("_host"), F.col("domain").alias("_domain"))
    return join_side_table(rows, found, ["_host"], how="left", spread_key=url_col).withColumn(out, F.col("_domain")).drop("_host", "_domain")


def internal_links(links: DataFrame, rules: DataFrame, href_col: str = "href", domain_col: str = "domain") -> DataFrame:
    """B6 by rules: links without a host, and those whose registered domain is ``domain_col``'s."""
    rows = with_registered_domain(links, rules, href_col, "_found")
    return rows.filter((F.col("_found") == "") | (F.col("_found") == F.lower(F.col(domain_col)))).drop("_found")
