"""Closeness by sketches whose registers are dealt to tasks."""

import numpy as np

from linkloom.operators import centrality as C
from linkloom.operators import sketches as K


def test_registers_follow_the_exact_sums(spark, monkeypatch):
    """no sketch is sent along an arc; estimates stay within the stated error, and few nodes are counted exactly."""
    monkeypatch.setattr(K, "_by_joins", None)
    rng = np.random.default_rng(8)
    n = 700
    arcs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (3 * n, 2))})
    rows = [("s", a, b, 1) for a, b in arcs] + [("t", i, i + 1, 1) for i in range(40)] + [("t", 90, 91, 1), ("u", 5, 5, 1), (None, 1, 2, 1), ("s", 3, None, 1)]
    edges = spark.createDataFrame(rows, "site string, source long, target long, weight int")
    nodes = spark.createDataFrame([("s", i) for i in range(n)] + [("t", i) for i in range(41)] + [("u", 5), ("s", None), (None, 1)], "site string, url long")
    got = {(r.site, r.url): r for r in K.closeness_sketch(nodes, edges, log2k=10).collect()}
    near = {(r.site, r.url): r for r in C.path_sums(nodes, edges).collect()}
    assert len(got) == n + 41 + 1
    for u, r in got.items():
        want = near[u] if u in near else None
        if u[0] == "t":  # 90 and 91 are no nodes
            assert (r.reached_by, r.total) == (u[1], u[1] * (u[1] + 1) / 2)
        elif want is None:
            assert (r.reached_by, r.total, r.closeness) == (0.0, 0.0, 0.0)
        else:
            assert abs(r.reached_by - want.reached_by) <= 5 * K.sketch_error(10) * want.reached_by
            assert abs(r.total - want.total) <= 5 * K.sketch_error(10) * want.total
    short = {(r.site, r.url): r for r in K.closeness_sketch(nodes, edges, log2k=10, max_distance=2).collect()}
    assert short["t", 30].reached_by == 2 and short["t", 30].total == 3


def test_large_graphs_join_whole_sketches(spark):
    nodes = spark.createDataFrame([("s", i) for i in range(5)], "site string, url long")
    edges = spark.createDataFrame([("s", i, i + 1, 1) for i in range(4)], "site string, source long, target long, weight int")
    one, two = ({r.url: (r.reached_by, r.total) for r in K.closeness_sketch(nodes, edges, graph_bytes=b).collect()} for b in (K.GRAPH_BYTES, 0))
    assert one.keys() == two.keys()
    for u, (reached, total) in one.items():
        assert abs(reached - two[u][0]) < 1e-6 and abs(total - two[u][1]) < 1e-6
