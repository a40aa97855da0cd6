"""Kept runs and their comparison."""

import itertools
import random

import numpy as np
import pytest

from linkloom.operators import shifts
from linkloom.sources import runs, tables


def nodes(spark, data):
    return spark.createDataFrame(data, "site string, url string, cluster int")


def best_by_trial(w):
    """The largest sum, and the assignment that comes first in order of the rows."""
    rows, cols = w.shape
    best = None
    for pick in itertools.product([*range(cols), None], repeat=rows):
        used = [p for p in pick if p is not None]
        if len(set(used)) < len(used) or any(w[i, p] <= 0 for i, p in enumerate(pick) if p is not None):
            continue
        key = (-sum(int(w[i, p]) for i, p in enumerate(pick) if p is not None), [cols if p is None else p for p in pick])
        if best is None or key < best[0]:
            best = (key, list(pick))
    return best[1]


def test_assignment_equals_all_trials():
    rng = np.random.default_rng(5)
    for _ in range(150):
        w = rng.integers(0, 4, (rng.integers(0, 5), rng.integers(0, 5))) * rng.integers(0, 2)
        assert shifts.assignment(w) == best_by_trial(w), w
    w = rng.integers(0, 1000, (40, 40))
    got = shifts.assignment(w)
    assert sorted(got) == list(range(40))


def test_renamed_clusters_stay(spark):
    rng = random.Random(2)
    before = [(s, f"u{i}", rng.randrange(5)) for s in ("a", "b") for i in range(60)]
    name = {s: rng.sample(range(10, 15), 5) for s in ("a", "b")}
    after = [(s, u, name[s][c]) for s, u, c in before]
    got = shifts.cluster_shifts(nodes(spark, before), nodes(spark, after)).collect()
    assert len(got) == 120 and {r.status for r in got} == {"stayed"}
    # ten pages move; renaming the ids of the second run changes no verdict
    moved = {(s, f"u{i}") for s in ("a", "b") for i in range(0, 50, 10)}
    plain = [(s, u, (c + 1) % 5 if (s, u) in moved else c) for s, u, c in before]
    renamed = [(s, u, name[s][c]) for s, u, c in plain]
    for data in (plain, renamed):
        got = shifts.cluster_shifts(nodes(spark, before), nodes(spark, data)).collect()
        assert {(r.site, r.url) for r in got if r.status == "moved"} == moved


def test_added_removed_and_unmatched(spark):
    before = nodes(spark, [("s", "a", 1), ("s", "b", 1), ("s", "c", 2), ("s", "d", None), ("t", "x", 1), ("s", "gone", 2)])
    after = nodes(spark, [("s", "a", 7), ("s", "b", 7), ("s", "c", 7), ("s", "d", 8), ("t", "y", 1), ("s", "e", 9)])
    got = {(r.site, r.url): (r.cluster_before, r.cluster_after, r.expected, r.status) for r in shifts.cluster_shifts(before, after).collect()}
    assert got == {("s", "a"): (1, 7, 7, "stayed"), ("s", "b"): (1, 7, 7, "stayed"), ("s", "c"): (2, 7, None, "moved"), ("s", "d"): (None, 8, None, "added"),
                   ("s", "e"): (None, 9, None, "added"), ("s", "gone"): (2, None, None, "removed"), ("t", "x"): (1, None, None, "removed"),
                   ("t", "y"): (None, 1, None, "added")}
    matches = {tuple(r) for r in shifts.cluster_matches(before, after).collect()}
    assert ("s", 1, 7, 2, 2, 3) in matches and ("s", 2, None, 0, 2, None) in matches and ("s", None, 8, 0, None, 1) in matches
    none = nodes(spark, [])
    assert shifts.cluster_shifts(none, none).count() == 0


def test_centrality_shifts(spark):
    kind = "site string, url string, pagerank double"
    a = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5)], kind)
    b = spark.createDataFrame([("s", "b", 0.25), ("s", "c", 0.75)], kind)
    got = {r.url: (r.status, r.pagerank_before, r.pagerank_after, r.pagerank_change) for r in shifts.centrality_shifts(a, b, ("pagerank",)).collect()}
    assert got == {"a": ("removed", 0.5, None, -0.5), "b": ("kept", 0.5, 0.25, -0.25), "c": ("added", None, 0.75, 0.75)}


def test_published_runs(spark, tmp_path):
    root = str(tmp_path / "out")
    with pytest.raises(LookupError):
        runs.open_run(spark, root)
    one = tables.conform(nodes(spark, [("s", "a", 1), ("t", "b", 2)]), "nodes")
    two = tables.conform(nodes(spark, [("s", "a", 5)]), "nodes")
    runs.publish({"nodes": one}, root, "may")
    held = runs.open_run(spark, root)
    runs.publish({"nodes": two}, root, "june")
    clusters = lambda run: sorted((r.url, r.cluster) for r in run.read("nodes").collect())
    assert clusters(runs.open_run(spark, root)) == [("a", 5)]
    assert clusters(runs.open_run(spark, root, "may")) == clusters(held) == [("a", 1), ("b", 2)]
    assert runs.open_run(spark, root).read("pillars").count() == 0
    assert {(r.run, r.url, r.cluster) for r in runs.history(spark, root, "nodes").collect()} == {("may", "a", 1), ("may", "b", 2), ("june", "a", 5)}


def test_an_aborted_write_leaves_the_old_run(spark, tmp_path):
    from pyspark.sql import functions as F

    root = str(tmp_path / "out")
    good = tables.conform(nodes(spark, [("s", "a", 1)]), "nodes")
    runs.publish({"nodes": good}, root, "may")
    broken = good.withColumn("cluster", F.when(F.col("url") == "a", F.raise_error(F.lit("lost"))).cast("int"))
    with pytest.raises(Exception):
        runs.publish({"nodes": good.withColumn("cluster", F.lit(9)), "pillars": broken}, root, "june")
    assert [r.run for r in runs.published(spark, root).collect()] == ["may"]
    assert [r.cluster for r in runs.open_run(spark, root).read("nodes").collect()] == [1]
    runs.publish({"nodes": good.withColumn("cluster", F.lit(4))}, root, "june")
    assert [r.cluster for r in runs.open_run(spark, root, "june").read("nodes").collect()] == [4]
