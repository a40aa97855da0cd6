import itertools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linkloom.operators import centrality as C
from linkloom.operators import graph as G
from linkloom.operators.sequence import next_in_order

# small directed graph: self-loops, a dangling node (5), an isolated node (6), weights
EDGES = [(0, 1, 3), (1, 2, 1), (2, 0, 2), (2, 3, 1), (3, 3, 4), (3, 4, 1), (4, 1, 1), (0, 5, 1), (1, 4, 2), (4, 4, 1)]
NODES = list(range(7))


def frames(spark):
    nodes = spark.createDataFrame([("s", n) for n in NODES], "site string, url long")
    edges = spark.createDataFrame([("s", a, b, w) for a, b, w in EDGES], "site string, source long, target long, weight long")
    return nodes, edges


def ref_pagerank(alpha=0.85, max_iter=100, tol=1e-6):
    n = len(NODES)
    W = np.zeros((n, n))
    for a, b, w in EDGES:
        W[a, b] += w
    out = W.sum(1)
    x = np.full(n, 1.0 / n)
    for _ in range(max_iter):
        last = x
        dm = x[out == 0].sum()
        x = alpha * ((x / np.where(out > 0, out, 1)) @ W + dm / n) + (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            break
    return x


def bfs_all():
    adj = {v: set() for v in NODES}
    for a, b, _ in EDGES:
        if a != b:
            adj[a].add(b)
    dist, sigma = {}, {}
    for s in NODES:
        d = {s: 0}
        sg = {s: 1}
        q = deque([s])
        while q:
            v = q.popleft()
            for w in sorted(adj[v]):
                if w not in d:
                    d[w] = d[v] + 1
                    q.append(w)
                if d[w] == d[v] + 1:
                    sg[w] = sg.get(w, 0) + sg[v]
        dist[s], sigma[s] = d, sg
    return dist, sigma


def test_pagerank_matches_power_iteration(spark):
    nodes, edges = frames(spark)
    got = {r.url: r.pagerank for r in C.pagerank(nodes, edges).collect()}
    want = ref_pagerank()
    for v in NODES:
        assert abs(got[v] - want[v]) < 1e-12
    assert abs(sum(got.values()) - 1.0) < 1e-9


def test_closeness_and_betweenness_brute_force(spark):
    nodes, edges = frames(spark)
    n = len(NODES)
    dist, sigma = bfs_all()
    d = C.path_sums(nodes, edges)
    cl = {r.url: r.closeness for r in C.closeness(nodes, d).collect()}
    bc = {r.url: r.betweenness for r in C.betweenness(nodes, d).collect()}
    for v in NODES:
        reach = [s for s in NODES if v in dist[s] and s != v]
        tot = sum(dist[s][v] for s in reach)
        want = 0.0 if tot == 0 else len(reach) / tot * (len(reach) / (n - 1))
        assert abs(cl[v] - want) < 1e-12
        b = 0.0
        for s, t in itertools.permutations(NODES, 2):
            if v in (s, t) or t not in dist[s] or v not in dist[s] or t not in dist[v]:
                continue
            if dist[s][v] + dist[v][t] == dist[s][t]:
                b += sigma[s][v] * sigma[v][t] / sigma[s][t]
        assert abs(bc[v] - b / ((n - 1) * (n - 2))) < 1e-12


def test_degrees_count_self_loops_once(spark):
    nodes, edges = frames(spark)
    deg = {r.url: (r.in_degree, r.out_degree) for r in C.degrees(nodes, edges).collect()}
    assert deg[3] == (2.0, 2.0) and deg[6] == (0.0, 0.0) and deg[5] == (1.0, 0.0)


def test_build_edges_weight_and_anchor_order(spark):
    links = [("s", "p", i, "q" if i % 2 else "r", f"a{60 - i:02d}") for i in range(1, 61)]
    df = spark.createDataFrame(links, "site string, src string, pos int, href string, anchor string")
    e = {r.target: r for r in G.build_edges(df).collect()}
    assert e["q"].weight == 30 and e["r"].weight == 30
    assert e["q"].anchors[:3] == ["a59", "a57", "a55"] and len(e["q"].anchors) == 30
    s = df.select(G.anchor_string(F.array(F.lit("b"), F.lit(""), F.lit("a"), F.lit("b"))).alias("s")).first().s
    assert s == "a | b"


def test_next_in_order_across_partitions(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ts": rng.integers(0, 50, 400), "eid": np.arange(400), "v": rng.integers(0, 9, 400)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = next_in_order(df, ["ts", "eid"], "v", "nv", num_partitions=5).toPandas().sort_values(["ts", "eid"])
    want = pdf.sort_values(["ts", "eid"])["v"].shift(-1)
    assert list(got["nv"].fillna(-1).astype(int)) == list(want.fillna(-1).astype(int))
