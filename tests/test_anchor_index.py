"""Anchor search by trigram lists equals the scan."""
import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.operators import anchor_index as AI
from linkloom.operators import reports as R

PIECES = ["abc", "read", "More", "x", ".", "ab?", "c*", "d+", "e+?", "[xyz]", "(?:foo)?", "(bar)", "(a|b)", "\\s", "\\.", "{", "k{2}", "m{0,2}", "$", "é", "--", "^", "\\Qz\\E",
          "|", "(?i)"]


def test_runs_stand_in_every_match():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["abc", "READ", "more", " ", "x", "foo", "bar", "b", "a", "d", "dd", "e", ".", "kk", "mm", "é", "--", "c", "z"]) for _ in range(rng.randint(0, 9)))
             for _ in range(600)]
    used = 0
    for _ in range(1500):
        pattern = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 5)))
        runs = AI.required_runs(pattern)
        if not runs:
            continue
        used += 1
        got = re.compile(pattern, re.I | re.A)
        for t in texts:
            if got.search(t):
                assert all(r in t.lower() for r in runs), (pattern, t, runs)
    assert used > 500
    assert AI.required_runs("read more") == ["read more"] and AI.required_runs("a|b") == [] and AI.required_runs("(?x)a b c") == []
    assert AI.required_runs("guides?") == ["guide"] and AI.required_runs("wo+rld") == ["wo", "orld"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    words = ["Read more", "the guide", "Guide to PageRank", "WORLD", "wooorld", "tél é", "İstanbul", "Kelvin scale", "", None, "a.b", "contact | about", "ab"]
    rows = [("s" if i % 3 else "t", f"u{i % 40}", f"v{i}", 1, words[i % len(words)]) for i in range(300)]
    edges = spark.createDataFrame(rows + rows[:2], "site string, source string, target string, weight int, anchors string")
    root = str(tmp_path_factory.mktemp("anchors") / "index")
    AI.build(edges, root, buckets=32, parts=4)
    return edges, AI.AnchorIndex(spark, root)


@pytest.mark.parametrize("q,regex", [("read more", True), ("guide( to)?", True), ("wo+rld", True), ("kelvin", False), ("kelvin", True), ("tél", False), ("a\\.b", True),
                                     ("ab", True), ("^$", True), ("read|guide", True), ("absent words", True), ("| about", False), ("stanbul", True), ("", True)])
def test_equals_the_scan(index, q, regex):
    edges, held = index
    want = R.anchor_search(edges, q, regex)
    cols = edges.columns
    assert sorted(map(str, held.search(q, regex).select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_reads_only_the_lists_it_needs(index):
    _, held = index
    assert held.choose("a|b") is None and held.choose("ab") is None and held.choose("absent words") == []
    chosen = held.choose("pagerank")
    assert len(chosen) == AI.LISTS and max(r.n for r in chosen) <= min(r.n for r in held.lists.filter(F.col("trigram").isin("pag", "age", "ger", "era", "ran", "ank")).collect()) * 2
    plan = held.postings(chosen)._jdf.queryExecution().executedPlan().toString()
    part, pushed = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan, re.S).groups()
    assert "bucket" in part and "trigram" in pushed


def test_empty_table(spark, tmp_path):
    edges = spark.createDataFrame([], "site string, source string, target string, weight int, anchors string")
    AI.build(edges, str(tmp_path / "i"))
    assert AI.AnchorIndex(spark, str(tmp_path / "i")).search("guide").count() == 0
