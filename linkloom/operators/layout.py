"""A 2-D layout that keeps neighbours together.

Spectral layout of the graph of nearest neighbours.  Its matrix is S = D^-1/2 (A + I) D^-1/2,
where A joins two pages if one is among the other's ``k`` nearest by cosine (exact, ``topk_similar``).
Orthogonal iteration of two columns, with the known first eigenvector sqrt(D) taken out, starts
from the linear plane; the coordinates are the columns over sqrt(D), so a page lies near the mean of
its neighbours.  In a graph of several parts many rounds draw each part together; ``rounds`` is where
to stop.

A round is a join of the links with one row per page, a sum per page and six sums per site, for all
sites at once.  Links are as many as pages times k; the column table is cut each round and the
superseded one removed.  The links of a page that many others are near to are split by AQE in the
join and summed in part before the shuffle.

Defined cases: a site of one or two pages, or whose vectors are all equal, has zeros where no
direction is left; coordinates have weighted mean 0 and, with weights D, mean square 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.clustering import layout_2d
from linkloom.operators.iterate import cut, discard
from linkloom.operators.joins import join_side_table
from linkloom.operators.similarity import topk_similar

EPS = 1e-20  # a squared length below this part of what it was counts as none


def neighbour_links(vecs: DataFrame, k: int = 15) -> DataFrame:
    """(site, source, target), both ways, of pages and their ``k`` nearest."""
    near = cut(topk_similar(vecs, k).select("site", "source", "target"))
    return near.union(near.select("site", F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def _orthonormal(cols: DataFrame) -> DataFrame:
    """(site, url, q, x, y): x and y freed of q and of each other, and scaled, by sums per site."""
    a, b = F.col("x"), F.col("y")
    s = cols.groupBy("site").agg(*[F.sum(v).alias(n) for n, v in (
        ("qq", F.col("q") * F.col("q")), ("qx", F.col("q") * a), ("qy", F.col("q") * b), ("xx", a * a), ("yy", b * b), ("xy", a * b))])
    free = s.select(
        "site", (F.col("qx") / F.col("qq")).alias("fx"), (F.col("qy") / F.col("qq")).alias("fy"), F.col("xx").alias("xx0"), F.col("yy").alias("yy0"),
        (F.col("xx") - F.col("qx") * F.col("qx") / F.col("qq")).alias("xx"), (F.col("yy") - F.col("qy") * F.col("qy") / F.col("qq")).alias("yy"),
        (F.col("xy") - F.col("qx") * F.col("qy") / F.col("qq")).alias("xy"))
    some = F.col("xx") > EPS + 1e-12 * F.col("xx0")
    free = free.withColumn("sx", F.when(some, 1 / F.sqrt("xx")).otherwise(0.0)).withColumn("g", F.when(some, F.col("xy") / F.col("xx")).otherwise(0.0))
    rest = F.col("yy") - F.col("g") * F.col("xy")
    free = free.withColumn("sy", F.when(rest > EPS + 1e-12 * F.col("yy0"), 1 / F.sqrt(rest)).otherwise(0.0)).select("site", "fx", "fy", "g", "sx", "sy")
    x = F.col("x") - F.col("fx") * F.col("q")
    y = F.col("y") - F.col("fy") * F.col("q") - F.col("g") * x
    return join_side_table(cols, free, ["site"]).select("site", "url", "q", (x * F.col("sx")).alias("x"), (y * F.col("sy")).alias("y"))


def neighbour_layout(vecs: DataFrame, k: int = 15, rounds: int = 12) -> DataFrame:
    """(site, url, vec) -> (site, url, x, y)."""
    vecs = cut(vecs.select("site", "url", "vec"))
    links = cut(neighbour_links(vecs, k))
    degree = links.groupBy("site", F.col("source").alias("url")).agg(F.count(F.lit(1)).alias("n"))
    start = layout_2d(vecs).join(degree, ["site", "url"], "left")
    cols = cut(start.select("site", "url", F.sqrt(F.coalesce("n", F.lit(0)) + 1.0).alias("q"), "x", "y"))
    for _ in range(rounds):
        now = cut(_orthonormal(cols).select("site", "url", "q", (F.col("x") / F.col("q")).alias("x"), (F.col("y") / F.col("q")).alias("y")))
        discard(cols)
        from_links = links.join(now.select("site", F.col("url").alias("target"), "x", "y"), ["site", "target"]).select("site", F.col("source").alias("url"), F.lit(0.0).alias("q"), "x", "y")
        total = from_links.union(now).groupBy("site", "url").agg(F.max("q").alias("q"), F.sum("x").alias("x"), F.sum("y").alias("y"))
        cols = cut(total.select("site", "url", "q", (F.col("x") / F.col("q")).alias("x"), (F.col("y") / F.col("q")).alias("y")))
        discard(now)
    done = _orthonormal(cols)
    size = done.groupBy("site").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("r"))
    return join_side_table(done, size, ["site"]).select("site", "url", (F.col("x") / F.col("q") * F.col("r")).alias("x"), (F.col("y") / F.col("q") * F.col("r")).alias("y"))
