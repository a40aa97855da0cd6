"""Closeness of large graphs by sketch propagation (E4 without a table of all pairs).

Each node keeps a distinct-count sketch of the nodes that reach it.  One round per distance
merges the sketches of its sources into it; the growth of the estimate from round t - 1 to t
is the number of nodes at distance t.  There is no row per pair.

While the arcs, as pairs of numbers, can be broadcast, no sketch is moved: a sketch is
2 ** log2k registers, each the largest rank of the hashes that fall to it, and registers don't meet
before the estimate.  So each task keeps some registers of all nodes, goes through all
rounds, and sends a row per node and round in which the node's registers grew.  Nodes that at most ``FEW`` others reach
are counted exactly.  Beyond that bound a round is one join with the arcs and one aggregation of whole sketches
that combines map-side, over as many rows as the graph has nodes and arcs.

Error: an estimate of r nodes has a relative standard error of ``sketch_error(log2k)``
(1.04 / sqrt(2 ** log2k)).  Closeness is r**2 over the
sum of distances, so to first order its error stays within a few times that; the exact form is
``closeness(nodes, path_sums(...))``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.centrality import GRAPH_BYTES, DistanceSearch, _span, numbered_graph, site_sizes, unweighted_arcs
from linkloom.operators.iterate import cut, discard
from linkloom.operators.joins import join_side_table

FEW = 64  # others that reach a node, at most, for it to be counted exactly
FEW_PAIRS = 1 << 18  # (node, one that reaches it) pairs that a task looks back from at once
REGISTER_BYTES = 64 << 20  # of a task's registers


def sketch_error(log2k: int) -> float:
    return 1.04 / 2 ** (log2k / 2)


def closeness_sketch(nodes: DataFrame, edges: DataFrame, log2k: int = 12, max_distance: int = 1000, graph_bytes: int = GRAPH_BYTES) -> DataFrame:
    """(site, url, reached_by, total, closeness): estimates of how many other nodes reach a node, of the sum of
    their distances, and of its closeness.  Rounds end when no sketch grows (or at ``max_distance``)."""
    arcs = cut(unweighted_arcs(edges))
    ids = nodes.select("site", "url").distinct()
    # nodes that only arcs name have no sketch of their own, which the numbered form takes for granted
    held = arcs.join(ids.toDF("site", "v"), ["site", "v"], "left_semi").join(ids.toDF("site", "w"), ["site", "w"], "left_semi")
    if 8 * arcs.count() <= graph_bytes:
        out = _by_registers(ids, cut(held), log2k, max_distance)
    else:
        out = _by_joins(ids, arcs, log2k, max_distance)
    r = F.col("reached_by")
    value = F.when((F.col("total") > 0) & (F.col("size") > 1), r / F.col("total") * F.least(F.lit(1.0), r / (F.col("size") - 1))).otherwise(0.0)
    return join_side_table(out, site_sizes(nodes).withColumnRenamed("n", "size"), ["site"]).select("site", "url", "reached_by", "total", value.alias("closeness"))


def estimate(h, empty, m: int):
    """Distinct count from the sum of 2 ** -rank of the ``m`` registers that aren't empty, and the number of empty ones
    (Ertl's improved estimator)."""
    x = empty / m
    grown, power, scale = x.copy(), x.copy(), 0.5
    while power.any() and scale < 2.0 ** 63:
        power, scale = power * power, 2 * scale
        grown += power * scale
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(empty >= m, 0.0, m * m / (2 * math.log(2) * (h + m * grown)))


class Registers(DistanceSearch):
    """Some registers of all nodes, a byte each."""

    op, of = np.maximum, np.uint8

    def rounds(self, cell: np.ndarray, rank: np.ndarray, first: int, width: int, max_distance: int):
        """For each distance: (nodes, by how much the sum of 2 ** -rank and the number of empty registers change)."""
        n = len(self.by_head[0]) - 1
        state, mine = np.zeros((n, width), np.uint8), np.flatnonzero((cell >= first) & (cell < first + width))
        state[mine, cell[mine] - first] = rank[mine]
        value = np.exp2(-np.arange(256.0))
        value[0] = 0.0
        yield 0, mine, value[rank[mine]], np.full(len(mine), -1)
        rows = mine
        for t in range(1, max_distance + 1):
            if not len(rows):
                break
            if 2 * int(_span(self.by_tail[0], rows)[1].sum()) < len(self.by_tail[1]):
                to, start, count, ends = self.followed(self.by_tail, rows, 0)
            else:
                to = np.flatnonzero(np.diff(self.by_head[0]))
                (start, count), ends = _span(self.by_head[0], to), self.by_head[1]
            grown, fresh, dh, dz = [], [], [], []
            for at, got in self.gather(state, start, count, ends, 0):
                old = state.take(to[at], axis=0)
                some = (got > old).any(axis=1)
                old, got = old[some], np.maximum(old[some], got[some])
                grown.append(to[at[some]])
                fresh.append(got)
                dh.append((value[got] - value[old]).sum(axis=1))
                dz.append(np.count_nonzero(got, axis=1) - np.count_nonzero(old, axis=1))
            if not grown or not sum(map(len, grown)):
                break
            # the others of this round still saw the last one
            for at, got in zip(grown, fresh):
                state[at] = got
            rows = np.concatenate(grown)
            yield t, rows, np.concatenate(dh), -np.concatenate(dz)


def reached_by_few(by_head: tuple, nodes: np.ndarray, few: int, max_distance: int):
    """(nodes, by how many others each is reached, sum of their distances) of those that at most ``few`` others reach."""
    n = len(by_head[0]) - 1
    indegree = np.diff(by_head[0])
    alive = np.ones(len(nodes), bool)
    at, back = np.arange(len(nodes)), nodes
    seen, held, total = at * n + nodes, np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for d in range(1, max_distance + 1):
        alive[at[indegree[back] > few + 1]] = False
        use = alive[at]
        at, back = at[use], back[use]
        count = indegree[back]
        ends = np.cumsum(count)
        other = by_head[1][np.arange(ends[-1] if len(ends) else 0) + np.repeat(by_head[0][back] - (ends - count), count)]
        keys = np.unique(np.repeat(at, count) * n + other)
        keys = keys[~np.isin(keys, seen)]
        if not len(keys):
            break
        at, back = keys // n, keys % n
        got = np.bincount(at, minlength=len(nodes))
        held += got
        total += got * d
        alive &= held <= few
        seen = np.concatenate((seen[alive[seen // n]], keys[alive[at]]))
        at, back = at[alive[at]], back[alive[at]]
    return nodes[alive], held[alive], total[alive]


def _by_registers(ids: DataFrame, arcs: DataFrame, log2k: int, max_distance: int) -> DataFrame:
    spark = ids.sparkSession
    ids = ids.filter(F.col("site").isNotNull() & F.col("url").isNotNull())
    verts, *graph = numbered_graph(arcs)
    m = 1 << log2k
    hashed = F.xxhash64(F.col("url").cast("string"))
    table = verts.select("no", hashed.alias("h")).toArrow()
    order, hashes = table["no"].to_numpy(), table["h"].to_numpy().view(np.uint64)
    cell, rank = np.zeros(len(order), np.int32), np.zeros(len(order), np.uint8)
    cell[order] = (hashes >> np.uint64(64 - log2k)).astype(np.int32)
    # rank: leading zeros of the other bits, and one
    rest = (hashes << np.uint64(log2k)) >> np.uint64(11)
    rank[order] = np.minimum(54 - np.frexp(rest.astype(np.float64))[1], 65 - log2k)
    shared = spark.sparkContext.broadcast((*graph, cell, rank))
    n = len(order)
    tasks = 2 * spark.sparkContext.defaultParallelism
    width = max(1, min(-(-m // tasks), REGISTER_BYTES // max(1, n)))
    slices = -(-m // width)

    def run(batches):
        by_tail, by_head, cell, rank = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                first = i * width
                for t, no, dh, dz in Registers(by_tail, by_head, 1).rounds(cell, rank, first, min(width, m - first), max_distance):
                    yield pa.RecordBatch.from_arrays([pa.array(no.astype(np.int64)), pa.array(np.full(len(no), t, np.int32)), pa.array(dh), pa.array(dz.astype(np.int64))],
                                                     ["no", "t", "dh", "dz"])

    grown = spark.range(0, slices, numPartitions=slices).mapInArrow(run, "no long, t int, dh double, dz long")
    grown = grown.groupBy("no", "t").agg(F.sum("dh").alias("dh"), F.sum("dz").alias("dz"))
    by_node = grown.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("t", "dh", "dz"))).alias("l"))
    by_node = by_node.select("no", F.col("l.t").alias("t"), F.col("l.dh").alias("dh"), F.col("l.dz").alias("dz"))

    def counted(batches):
        _, by_head, *_ = shared.value
        for b in batches:
            no, sizes = b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            t, dh, dz = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
            begins = np.cumsum(sizes) - sizes
            run_h, run_z = np.cumsum(dh), np.cumsum(dz)
            base_h, base_z = (np.repeat((x - y)[begins], sizes) for x, y in ((run_h, dh), (run_z, dz)))
            got = estimate(run_h - base_h, (m + run_z - base_z).astype(np.float64), m)
            got = np.maximum(got, 1.0)
            # a node itself is one; estimates never fall
            got[begins] = 1.0
            step = np.repeat(np.arange(len(no)), sizes)
            got = _rising(got, step)
            more = np.diff(got, prepend=0.0)
            more[begins] = 0.0
            reached, total = got[begins + sizes - 1] - 1.0, np.bincount(step, more * t, len(no))
            for i in range(0, len(no), max(1, FEW_PAIRS // FEW)):
                mine = np.arange(i, min(len(no), i + max(1, FEW_PAIRS // FEW)))
                few, held, far = reached_by_few(by_head, no[mine], FEW, max_distance)
                at = mine[np.isin(no[mine], few)]
                reached[at], total[at] = held, far
            yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(reached), pa.array(total)], ["no", "reached_by", "total"])

    sums = by_node.mapInArrow(counted, "no long, reached_by double, total double")
    sums = verts.join(sums, "no").select("site", "url", "reached_by", "total")
    zero = F.lit(0.0)
    return ids.join(cut(sums), ["site", "url"], "left").select("site", "url", F.coalesce("reached_by", zero).alias("reached_by"), F.coalesce("total", zero).alias("total"))


def _rising(got: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Running maximum of each step's values, which are at least 1 and below 2 ** 64."""
    if not len(got):
        return got
    lift = step * (got.max() + 1.0)
    whole = np.maximum.accumulate(got + lift) - lift
    return np.maximum(got, whole)


def _by_joins(ids: DataFrame, arcs: DataFrame, log2k: int, max_distance: int) -> DataFrame:
    state = cut(ids.groupBy("site", "url").agg(F.hll_sketch_agg(F.col("url").cast("string"), log2k).alias("sketch")).select(
        "site", "url", "sketch", F.lit(1.0).alias("n"), F.lit(0.0).alias("total"), F.lit(True).alias("grew")))
    for t in range(1, max_distance + 1):
        # a node whose sketch didn't grow has nothing new to tell
        sent = state.filter("grew").select("site", F.col("url").alias("v"), "sketch").join(arcs, ["site", "v"])
        got = sent.select("site", F.col("w").alias("url"), "sketch").unionByName(state.select("site", "url", "sketch"))
        merged = got.groupBy("site", "url").agg(F.hll_union_agg("sketch").alias("sketch"))
        new = F.greatest(F.hll_sketch_estimate("sketch").cast("double"), F.col("n"))
        old, state = state, cut(merged.join(state.select("site", "url", "n", "total"), ["site", "url"]).select(
            "site", "url", "sketch", new.alias("n"), (F.col("total") + t * (new - F.col("n"))).alias("total"), (new > F.col("n")).alias("grew")))
        discard(old)
        if state.filter("grew").isEmpty():
            break
    return state.select("site", "url", (F.col("n") - 1).alias("reached_by"), "total")
