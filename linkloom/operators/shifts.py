"""Comparison of two runs (H23): centrality changes and cluster shifts.

Cluster ids are arbitrary, so the clusters of both runs are matched first: pages are counted
by (cluster before, cluster after), and a site's matching is the one-to-one assignment with
the most pages kept.  Of several such, the one whose ids after, read in order of the ids
before, come first.  Clusters that share no page are not matched.  Renaming the ids of a run
therefore changes no page's verdict unless two assignments keep equally many pages.

Counting is one join and one aggregation over the pages; only a site's table of counts
(clusters x clusters, whatever the number of pages) is assigned in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut
from linkloom.operators.joins import join_side_table

METRICS = ("pagerank", "betweenness", "closeness", "in_degree", "out_degree")


def centrality_shifts(before: DataFrame, after: DataFrame, metrics: tuple = METRICS) -> DataFrame:
    """(site, url, status, and per metric its value before, after and the change); a page that one
    run doesn't have counts as 0 in the change and is ``added`` or ``removed``."""
    a = before.select("site", "url", F.lit(True).alias("_a"), *[F.col(m).alias(f"{m}_before") for m in metrics])
    b = after.select("site", "url", F.lit(True).alias("_b"), *[F.col(m).alias(f"{m}_after") for m in metrics])
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept")
    out = a.join(b, ["site", "url"], "full").withColumn("status", status)
    zero = F.lit(0.0)
    cols = [c for m in metrics for c in (F.col(f"{m}_before"), F.col(f"{m}_after"), (
        F.coalesce(F.col(f"{m}_after"), zero) - F.coalesce(F.col(f"{m}_before"), zero)).alias(f"{m}_change"))]
    return out.select("site", "url", "status", *cols)


def assignment(weight: np.ndarray) -> list:
    """For each row the column it is assigned (None without one): the largest sum of positive weights,
    the first in order of the rows among equals."""
    rows, cols = weight.shape
    n = rows + cols
    # row i may stay alone (column cols + i); column j may stay alone (row rows + j)
    forbidden = -(int(weight.sum()) + 1)
    w = np.zeros((n, n), object)
    w[:rows, :cols] = np.where(weight > 0, weight, forbidden).astype(object)
    w[:rows, cols:] = np.where(np.eye(rows, dtype=bool), 0, forbidden).astype(object)
    cost = -w
    u, v, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # potentials; owner[j]: row of column j (1-based, 0 for none)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, used = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[j]:
            used[j] = True
            row, delta, to = owner[j], None, 0
            for k in range(1, n + 1):
                if not used[k]:
                    left = cost[row - 1, k - 1] - u[row] - v[k]
                    if least[k] is None or left < least[k]:
                        least[k], way[k] = left, j
                    if delta is None or least[k] < delta:
                        delta, to = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[owner[k]] += delta
                    v[k] -= delta
                elif least[k] is not None:
                    least[k] -= delta
            j = to
        while j:
            owner[j], j = owner[way[j]], way[j]
    has = {owner[j] - 1: j - 1 for j in range(1, n + 1)}
    # every best assignment uses edges without slack only; rows take their first such column that leaves one for the rest
    free = [[j for j in range(n) if cost[i, j] == u[i + 1] + v[j + 1]] for i in range(n)]
    held = {j: i for i, j in has.items()}

    def moved(i: int, seen: set, fixed: set) -> bool:
        for j in free[i]:
            if j not in seen and j not in fixed:
                seen.add(j)
                if held.get(j) is None or moved(held[j], seen, fixed):
                    held[j], has[i] = i, j
                    return True
        return False

    fixed: set = set()
    for i in range(rows):
        for j in free[i]:
            if j in fixed:
                continue
            if has[i] == j:
                break
            other, old, saved = held[j], has[i], (dict(has), dict(held))
            held[j], has[i] = i, j
            held[old] = None
            if moved(other, {j}, fixed | {j}):
                break
            has, held = saved
        fixed.add(has[i])
    return [has[i] if has[i] < cols else None for i in range(rows)]


def cluster_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site, cluster_before, cluster_after, shared, size_before, size_after): matched clusters; a cluster
    without a partner has null on the other side and shares 0."""
    a = before.filter("cluster IS NOT NULL").select("site", "url", F.col("cluster").alias("cluster_before"))
    b = after.filter("cluster IS NOT NULL").select("site", "url", F.col("cluster").alias("cluster_after"))
    both = a.join(b, ["site", "url"], "full")
    counts = both.groupBy("site", "cluster_before", "cluster_after").agg(F.count(F.lit(1)).alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}

    def run(t: pd.DataFrame) -> pd.DataFrame:
        # object columns keep integers beside nulls
        rows = [(None if pd.isna(x) else x, None if pd.isna(y) else y, int(n)) for x, y, n in zip(t["cluster_before"], t["cluster_after"], t["n"])]
        old = sorted({x for x, _, _ in rows if x is not None})
        new = sorted({y for _, y, _ in rows if y is not None})
        shared = np.zeros((len(old), len(new)), np.int64)
        size_old, size_new = dict.fromkeys(old, 0), dict.fromkeys(new, 0)
        for x, y, n in rows:
            if x is not None:
                size_old[x] += n
            if y is not None:
                size_new[y] += n
            if x is not None and y is not None:
                shared[old.index(x), new.index(y)] += n
        out, taken = [], set()
        for i, j in enumerate(assignment(shared)):
            partner = None if j is None else new[j]
            taken.add(partner)
            out.append((old[i], partner, 0 if j is None else int(shared[i, j]), size_old[old[i]], None if j is None else size_new[partner]))
        out += [(None, y, 0, None, size_new[y]) for y in new if y not in taken]
        names = ["cluster_before", "cluster_after", "shared", "size_before", "size_after"]
        made = pd.DataFrame({c: pd.Series([r[k] for r in out], dtype=object) for k, c in enumerate(names)})
        made.insert(0, "site", t["site"].iloc[0] if len(t) else None)
        return made

    return counts.groupBy("site").applyInPandas(
        run, f"site {kinds['site']}, cluster_before {kinds['cluster_before']}, cluster_after {kinds['cluster_after']}, shared long, size_before long, size_after long")


def cluster_shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site, url, cluster_before, cluster_after, expected, status): ``expected`` is the cluster matched with the
    page's former one; status: stayed, moved, added, removed (no cluster in the one run or the other)."""
    matches = cut(cluster_matches(before, after).filter("cluster_before IS NOT NULL"))
    a = before.filter("cluster IS NOT NULL").select("site", "url", F.col("cluster").alias("cluster_before"))
    b = after.filter("cluster IS NOT NULL").select("site", "url", F.col("cluster").alias("cluster_after"))
    a = join_side_table(a, matches.select("site", "cluster_before", F.col("cluster_after").alias("expected")), ["site", "cluster_before"], "left")
    status = (F.when(F.col("cluster_before").isNull(), "added").when(F.col("cluster_after").isNull(), "removed")
              .when(F.col("cluster_after") == F.col("expected"), "stayed").otherwise("moved"))
    return a.join(b, ["site", "url"], "full").select("site", "url", "cluster_before", "cluster_after", "expected", status.alias("status"))
