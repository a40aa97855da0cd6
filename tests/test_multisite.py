"""Many sites in one job give the same results as each site alone."""
import numpy as np

from linkloom.operators import centrality as C
from linkloom.operators import tfidf as TF

G1 = [(0, 1, 3), (1, 2, 1), (2, 0, 2), (2, 3, 1), (3, 3, 4), (3, 4, 1), (4, 1, 1), (0, 5, 1)]
G2 = [(0, 1, 1), (1, 0, 1), (1, 2, 5), (2, 2, 1), (3, 0, 2)]


def frames(spark, graphs):
    nodes, edges = [], []
    for site, (es, n) in graphs.items():
        nodes += [(site, v) for v in range(n)]
        edges += [(site, a, b, w) for a, b, w in es]
    return (spark.createDataFrame(nodes, "site string, url long"),
            spark.createDataFrame(edges, "site string, source long, target long, weight long"))


def as_dict(df, col):
    return {(r.site, r.url): getattr(r, col) for r in df.collect()}


def test_graph_metrics_per_site(spark):
    both = {"a": (G1, 7), "b": (G2, 4)}
    n, e = frames(spark, both)
    pr = as_dict(C.pagerank(n, e), "pagerank")
    d = C.path_sums(n, e)
    cl = as_dict(C.closeness(n, d), "closeness")
    bc = as_dict(C.betweenness(n, d), "betweenness")
    for site, g in both.items():
        n1, e1 = frames(spark, {site: g})
        d1 = C.path_sums(n1, e1)
        for ref, got in ((as_dict(C.pagerank(n1, e1), "pagerank"), pr),
                         (as_dict(C.closeness(n1, d1), "closeness"), cl),
                         (as_dict(C.betweenness(n1, d1), "betweenness"), bc)):
            for k, v in ref.items():
                assert abs(got[k] - v) < 1e-12, (site, k)
        assert abs(sum(v for (s, _), v in pr.items() if s == site) - 1.0) < 1e-9


def test_tfidf_vocabulary_and_idf_per_site(spark):
    docs = [("a", 1, "alpha beta gamma"), ("a", 2, "alpha beta"), ("a", 3, "gamma delta"),
            ("b", 1, "alpha alpha beta"), ("b", 2, "alpha beta"), ("b", 3, "beta")]
    df = spark.createDataFrame(docs, "site string, url long, text string")
    both = {(r.site, r.url, r.term): r.w for r in TF.tfidf(df, stops=[]).collect()}
    for site in ("a", "b"):
        one = {(r.site, r.url, r.term): r.w for r in TF.tfidf(df.filter(f"site = '{site}'"), stops=[]).collect()}
        assert one and all(np.isclose(both[k], v, atol=1e-12) for k, v in one.items())
        assert {k for k in both if k[0] == site} == set(one)
