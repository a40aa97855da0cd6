"""Operator 5, embedding near-dedup with spherical-cap filters.

Vectors are scaled to unit length and, for each of TABLES random rotations, cut
into two halves; each half has a random code of unit vectors, and a filter
direction is a pair of codewords.  A vector belongs to every filter whose
direction it exceeds ``height`` with.  List decoding names only those: a codeword
of the first half is followed up only if the best one of the second can still
reach the height.  Rows meet on (label, filter), and every pair is verified.

The codes grow with the number of vectors of a label, so that a filter holds a
few vectors (beyond MAX_CODE codewords, about 17 million vectors of a label, filters hold more and are cut into more blocks), and ``height`` is set from the codes alone: as high as it
may be while simulated pairs at the threshold share a filter with probability
``recall`` (pairs above the threshold share one more often).

Equal vectors of a label (128-bit hashes) are one class and are compared once.  Classes travel as
16-bit floats.  A pair whose rounded cosine is clear of the threshold (by far more
than rounding can change) is decided in the cell; the few others are verified by
the cosine of their own vectors in double precision.  A filter with many classes
is cut into blocks and compared block against block.  What leaves a task for the
clear links is, per class and cell, the number of vectors linked and the least
linked class; a pair that shares several filters counts only in the first.

Defined cases: null labels, null, empty or zero vectors, and vectors with null or
non-finite components link with nothing; so do vectors of different lengths; null
identifiers link with nothing and stand for themselves; repeated rows are copies;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.hot import hot_join
from linkloom.operators.iterate import cut

BLOCK, TABLES, MAX_CODE = 512, 8, 2048
MARGIN = 4e-3  # rounding to 16 bits changes a cosine by less than 2 * 2**-11 + 2**-22
SAME = ["same_a", "same_b"]
LINK = "cls long, n_links long, low long, sure boolean"


class Caps:
    """Rotations, codes and the height of the caps for one dimension."""

    def __init__(self, dim: int, size: int, cosine: float, recall: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half, self.size = max(1, dim // 2), size
        self.tables = []
        for _ in range(TABLES):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            codes = []
            for d in (self.half, max(1, dim - self.half)):
                code = rng.standard_normal((size, d))
                codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(2))
            self.tables.append((turn, *codes))
        x, y = rng.standard_normal((2, 1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        # the best filter each pair shares: largest over directions of the smaller product
        best = np.max([self._shared(t, x, y) for t in self.tables], axis=0)
        self.height = float(np.quantile(best, 1 - recall))

    def halves(self, table, x):
        turn, one, two = table
        x = x @ turn
        rest = x[:, self.half:] if x.shape[1] > self.half else np.zeros((len(x), 1))
        return x[:, :self.half] @ one.T, rest @ two.T

    def _shared(self, table, x, y):
        (a1, a2), (b1, b2) = self.halves(table, x), self.halves(table, y)
        i, j = (np.argsort(-np.minimum(u, v), axis=1)[:, :32] for u, v in ((a1, b1), (a2, b2)))
        a1, b1, a2, b2 = (np.take_along_axis(m, k, 1) for m, k in ((a1, i), (b1, i), (a2, j), (b2, j)))
        return np.array([np.minimum(p[:, None] + q, r[:, None] + s).max() for p, q, r, s in zip(a1, a2, b1, b2)])

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each row of unit vectors."""
        out = []
        for at in range(0, len(x), 256):
            rows, numbers = [], []
            for t, table in enumerate(self.tables):
                one, two = self.halves(table, x[at:at + 256])
                row, first = np.nonzero(one + two.max(axis=1, keepdims=True) >= self.height)
                k, second = np.nonzero(two[row] >= self.height - one[row, first][:, None])
                rows.append(row[k])
                numbers.append((t * self.size + first[k]) * np.int64(self.size) + second)
            row, number = np.concatenate(rows), np.concatenate(numbers)
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
            split = np.searchsorted(row, np.arange(min(256, len(x) - at) + 1))
            out += [number[a:b] for a, b in zip(split[:-1], split[1:])]
        return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def rounded(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit floats; a vector's largest component is a safe scale for its length."""
    return unit(vectors / np.abs(vectors).max(axis=1, keepdims=True)).astype(np.float16)


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least filter common to each pair of rows; rows are padded with -1 (a) and -2 (b)."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for at in range(0, len(a), 20_000):
        x, y = a[at:at + 20_000], b[at:at + 20_000]
        for col in x.T:
            hit = (y == col[:, None]).any(axis=1)
            out[at:at + 20_000][hit] = np.minimum(out[at:at + 20_000][hit], col[hit])
    return out


def padded(lists: list, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def compared(table: pa.Table, cosine: float, caps: Caps) -> pa.Table:
    """Clear links of the cells of one group, summed up by class, and the unclear pairs (cls, low)."""
    table = table.sort_by("cell")
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    mine, cls, n, cell, number = (table[c].to_numpy() for c in ("mine", "cls", "copies", "cell", "filter"))
    half = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float16).reshape(len(cls), -1)
    us, vs, clear = [], [], []
    bounds = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    for f, t in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        a, b = (f + np.flatnonzero(mine[f:t] == k) for k in (i, j))
        c = unit(half[a].astype(np.float64)) @ unit(half[b].astype(np.float64)).T
        near = c >= cosine - MARGIN
        if i == j:
            near = np.triu(near, 1)
        u, v = np.nonzero(near)
        us.append(a[u])
        vs.append(b[v])
        clear.append(c[u, v] >= cosine + MARGIN)
    u, v, clear = (np.concatenate(x) for x in (us, vs, clear))
    if len(u):
        used, back = np.unique(np.concatenate((u, v)), return_inverse=True)
        lists = caps.filters(unit(half[used].astype(np.float64)))
        one, two = padded(lists, -1), padded(lists, -2)
        first = first_common(one[back[:len(u)]], two[back[len(u):]]) == number[u]
        u, v, clear = u[first], v[first], clear[first]
    own, back = np.unique(cls, return_inverse=True)
    both, other = np.concatenate((u[clear], v[clear])), np.concatenate((v[clear], u[clear]))
    links, low = np.zeros(len(own), np.int64), np.full(len(own), np.iinfo(np.int64).max)
    np.add.at(links, back[both], n[other])
    np.minimum.at(low, back[both], cls[other])
    has = np.flatnonzero(links)
    p, q = cls[u[~clear]], cls[v[~clear]]
    return pa.table({"cls": np.concatenate((own[has], p)), "n_links": np.concatenate((links[has], np.zeros(len(p), np.int64))),
                     "low": np.concatenate((low[has], q)), "sure": np.concatenate((np.ones(len(has), bool), np.zeros(len(p), bool)))})


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """Of the pairs (cls, low) those whose own vectors reach the cosine, as links of both.  Classes with more than a
    thousandth of the pairs, which are at most about 1,000, are broadcast to them."""
    total = pairs.count()

    def with_vectors(rows, c):
        own = classes.select(F.col("cls").alias(c), F.col("v").alias(f"v_{c}"), F.col("copies").alias(f"n_{c}"))
        return hot_join(rows, pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n")).join(own, c), [c], total, most=1000)

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                x, y = (np.array(z) / np.abs(z).max() for z in (x, y))
                ok.append(bool(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine))
            yield b.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))

    good = with_vectors(with_vectors(pairs, "cls"), "low").select("cls", "low", "n_cls", "n_low", "v_cls", "v_low").mapInArrow(
        run, "cls long, low long, n_cls long, n_low long")
    return good.select(F.explode(F.array(F.struct("cls", F.col("n_low").alias("n_links"), "low"),
                                         F.struct(F.col("low").alias("cls"), F.col("n_cls").alias("n_links"), F.col("cls").alias("low")))).alias("x")).select("x.*")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.93, recall: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = cut(rows.select("vec_id", *[F.when(usable, F.xxhash64(F.lit(i), "label", "v")).alias(c) for i, c in enumerate(SAME)],
                           F.col("label"), F.when(usable, F.col("v")).alias("v")))
    # numbered as they are written: no two classes share a number
    classes = cut(rows.filter(F.col(SAME[0]).isNotNull()).groupBy(*SAME).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
        .withColumn("cls", F.monotonically_increasing_id()))

    found = None
    for dim, of_label in classes.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count")).collect():
        size = int(np.clip(2 ** round(np.log2(max(of_label, 1)) / 2 - 1), 16, MAX_CODE))
        part = linked_in_cells(classes.filter(F.size("v") == dim), Caps(dim, size, cosine, recall), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = cut(found)
    unclear = cut(found.filter("not sure").select("cls", "low").distinct())
    found = cut(found.filter("sure").drop("sure").unionByName(verified(unclear, classes, cosine)))
    linked = found.groupBy("cls").agg(F.sum("n_links").alias("n_links"))
    label = components(found.select(F.col("cls").alias("u"), F.col("low").alias("v")))
    lowest = label.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = label.join(lowest, "label").select(F.col("node").alias("cls"), "component_id")
    known = (classes.select("cls", *SAME, "rep", F.col("copies").alias("n")).join(linked, "cls", "left").join(of_class, "cls", "left")
             .select(*SAME, "n", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
                     F.coalesce("component_id", "rep").alias("component_id")).filter("n_links > 0"))
    mine = F.coalesce("component_id", "vec_id")
    return hot_join(rows.select("vec_id", *SAME), known, SAME, rows.count(), how="left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), mine.alias("component_id"),
        F.col("vec_id").eqNullSafe(mine).alias("kept"))


def linked_in_cells(classes: DataFrame, caps: Caps, cosine: float) -> DataFrame:
    """LINK rows of the classes of one dimension.  Small filters share a group; a large
    one is dealt to blocks that meet two by two."""
    def run(batches):
        for b in batches:
            v = b.column(3)
            half = rounded(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1))
            lists = caps.filters(unit(half.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in half], pa.binary()),
                                              pa.array(lists, pa.list_(pa.int64()))], ["cls", "label", "copies", "vector", "filters"])

    placed = cut(classes.select("cls", "label", "copies", "v").mapInArrow(
        run, "cls long, label string, copies long, vector binary, filters array<long>"))
    posts = placed.select("cls", F.explode("filters").alias("filter"), "label").withColumn("cell", F.xxhash64("label", "filter")).drop("label")
    sizes = posts.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    posts = posts.join(sizes, "cell")
    groups = placed.agg(F.coalesce(F.sum(F.size("filters")), F.lit(0))).first()[0] // (4 * BLOCK) + 1
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    posts = (posts.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("grp", F.when(F.col("blocks") == 1, F.pmod(F.col("cell"), F.lit(groups))).otherwise(F.col("cell"))))
    cells = posts.select("cls", "filter", "cell", "grp", (F.col("blocks") == 1).alias("alone"), F.least("mine", "other").alias("i"),
                         F.greatest("mine", "other").alias("j"), "mine").join(placed.select("cls", "copies", "vector"), "cls")
    return cells.groupBy("grp", "alone", "i", "j").applyInArrow(lambda t: compared(t, cosine, caps), LINK)
