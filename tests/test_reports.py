"""Report helpers on literal tables: the dashboard's edge rules."""
from pyspark.sql import functions as F

from linkloom.operators import reports as R

NODES = [("s", "a", "A title that is definitely longer than forty characters!", True, 0, "k0"),
         ("s", "b", "", True, 1, None), ("s", "c", "Short", False, None, None), ("s", "d", None, True, 21, "k1")]
NSCHEMA = "site string, url string, title string, is_article boolean, cluster int, cluster_keywords string"


def test_node_style_flat_range_and_colors(spark):
    nodes = spark.createDataFrame(NODES, NSCHEMA)
    cent = spark.createDataFrame([("s", "a", 0.25), ("s", "b", 0.25)], "site string, url string, pagerank double")
    got = {r.url: (r.size, r.color) for r in R.node_style(nodes, cent).collect()}
    # a, b have 0.25; c, d missing -> 0.0; range 0.25 -> sizes 15 or 40
    assert got["a"] == (40.0, R.PALETTE[0]) and got["c"] == (15.0, R.NO_CLUSTER_COLOR)
    assert got["d"][1] == R.PALETTE[1]  # 21 mod 20
    flat = spark.createDataFrame([("s", u, 0.1) for u in "abcd"], "site string, url string, pagerank double")
    assert {r.size for r in R.node_style(nodes, flat).collect()} == {15.0}


def test_labels_and_tooltips(spark):
    nodes = spark.createDataFrame(NODES, NSCHEMA).withColumn("pillar_sim", F.when(F.col("url") == "a", F.lit(0.12345)))
    got = {r.url: (r.label, r.tooltip) for r in R.node_tooltip(nodes).collect()}
    assert got["a"][0] == NODES[0][2][:40] + "…"
    assert got["a"][1] == f"<b>Title</b>: {NODES[0][2]}<br/><b>Cluster</b>: 0<br/><b>Pillar sim</b>: 0.123"
    assert got["b"] == ("b", "<b>Cluster</b>: 1")
    assert got["c"] == ("Short", "<b>Title</b>: Short")


def test_filter_graph_and_link_share(spark):
    nodes = spark.createDataFrame(NODES, NSCHEMA)
    edges = spark.createDataFrame([("s", "a", "b", 3), ("s", "a", "d", None), ("s", "b", "a", 1), ("s", "c", "a", 5),
                                   ("s", "d", "d", 2)], "site string, source string, target string, weight long")
    _, e = R.filter_graph(nodes, edges, article_only=True, min_weight=1)
    assert {(r.source, r.target) for r in e.collect()} == {("a", "b"), ("a", "d"), ("b", "a"), ("d", "d")}
    _, e = R.filter_graph(nodes, edges, article_only=True, clusters=[0, 1], min_weight=2)
    assert {(r.source, r.target) for r in e.collect()} == {("a", "b")}
    _, e = R.filter_graph(nodes, edges, article_only=True, hide_cross=True)
    assert {(r.source, r.target) for r in e.collect()} == {("d", "d")}
    share = R.cluster_link_share(nodes, edges).first()
    assert (share.within_links, share.total_links) == (1, 4)


def test_pixel_layout_and_bands(spark):
    lay = spark.createDataFrame([("s", "a", 0.0, 0.0, 0), ("s", "b", 2.0, 1.0, 0), ("s", "c", 1.0, 4.0, 1)],
                                "site string, url string, x double, y double, cluster int")
    px = {r.url: (round(r.px, 3), round(r.py, 3)) for r in R.pixel_layout(lay).collect()}
    # range x=2, y=4 -> scale 900/4 = 225; centre (1, 2); y flipped
    assert px == {"a": (-225.0, 450.0), "b": (225.0, 225.0), "c": (0.0, -450.0)}
    recs = spark.createDataFrame([("s", 0.71), ("s", 0.7), ("s", 0.5), ("s", 0.49)], "site string, similarity double")
    assert {r.band: r.n for r in R.priority_bands(recs).collect()} == {"high": 1, "medium": 2, "low": 1}
