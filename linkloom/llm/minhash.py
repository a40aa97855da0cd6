"""Operator 3, MinHash near-dedup by a signature-coordinate inverted join.

A document's set is its distinct five-word shingles (64-bit hashes).  Documents
with equal sets (128-bit hashes) form one class; a class, numbered when the table of classes is written, is posted under each of its COORDS
(coordinate, minimum) pairs.  Two classes at similarity 0.75 agree on each
coordinate with probability 0.75, so asking for MATCHES of 64 agreements loses a
pair at the very threshold about once in 10**5 and hardly any above it.

* Prefix: with all pairs in one order, rarest first, classes that agree MATCHES
  times share a pair among the first ``COORDS - MATCHES + 1`` of each.  Only those
  are joined.  Pairs from a passage that many documents share are frequent and
  come last, and a class with fewer than MATCHES posted pairs that any other has
  is out at once.
* Skip: classes that share a list, directly or through others, form a cluster.  A
  cluster's members meet, each with its whole signature and set, in one cell or, if
  it is large, in blocks by size class.  Coordinates are counted in memory; the best
  agreeing pairs are confirmed first and pairs already connected are skipped, so a
  family of copies costs about as many checks as it has members, and what leaves a
  task is no more than a link per member.

Every link is confirmed on the full sets: 100 * shared >= 75 * union.

Defined cases: null or wordless text has no shingles and links with nothing; with
one to four words the whole sequence is one shingle; null identifiers link with
nothing and stand for themselves; rows that repeat an identifier are members of
the class of their own text; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.components import components
from linkloom.llm.hot import hot_join
from linkloom.llm.words import Powers, ddl_of, mix, small_batches, word_chunks
from linkloom.operators.iterate import cut

WIDTH, COORDS, MATCHES = 5, 64, 31
BLOCK, BLOCK_SHINGLES = 512, 400_000
MAX_WANTED = 4_000_000
SET_ID = ["set_a", "set_b"]
SIG = "set_a long, set_b long, doc_id long, n_shingles long, sig array<int>"


def shingle_sets(column, pw: Powers):
    """Yield the sorted distinct shingle hashes of each text, in row order."""
    m = np.cumprod(np.full(WIDTH, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
    for _, w in word_chunks(column, pw=pw):
        s = np.zeros(max(0, len(w.h) - WIDTH + 1), np.uint64)
        for j in range(WIDTH):
            s += w.h[j:j + len(s)] * m[j]
        s = mix(s)
        for d in range(w.n_docs):
            f, n = int(w.first[d]), int(w.count[d])
            if n >= WIDTH:
                yield np.unique(s[f:f + n - WIDTH + 1])
            elif n:
                yield mix((w.h[f:f + n] * m[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield s[:0]


def set_ids(sets: list[np.ndarray]) -> list[pa.Array]:
    """A 128-bit identifier of each set, as two columns; null for empty sets."""
    n = np.array([len(s) for s in sets])
    out = np.zeros((2, len(sets)), np.int64)
    if n.any():
        every = np.concatenate(sets)
        starts = (np.cumsum(n) - n)[n > 0]
        for row, plus in zip(out, (77, 0x9E3779B97F4A7C15)):
            row[n > 0] = mix(np.add.reduceat(mix(every + np.uint64(plus)), starts)).view(np.int64)
    return [pa.array(row, mask=n == 0) for row in out]


def signatures(sets: list[np.ndarray], a, b) -> np.ndarray:
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(every * a[k] + b[k], starts) >> np.uint64(32)
    return out


def grouped(items, weight, most):
    """Lists of successive items of about ``most`` weight together."""
    run, total = [], 0
    for x in items:
        run.append(x)
        total += weight(x)
        if total >= most:
            yield run
            run, total = [], 0
    if run:
        yield run


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, text -> SIG; the set's identifier and sig are null for documents without shingles."""
    rng = np.random.default_rng(20240501)
    a = rng.integers(0, 1 << 63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, COORDS, np.uint64)

    def run(batches):
        pw = Powers()
        for batch in batches:
            ids, at = batch.column(0), 0
            for sets in grouped(shingle_sets(batch.column(1), pw), len, 200_000):
                n = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                sig = np.zeros((len(sets), COORDS), np.uint32)
                if full:
                    sig[n > 0] = signatures(full, a, b)
                sig_column = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDS),
                                                      pa.array(sig.view(np.int32).ravel()), mask=pa.array(n == 0))
                yield pa.RecordBatch.from_arrays([*set_ids(sets), ids.slice(at, len(sets)), pa.array(n), sig_column],
                                                 [*SET_ID, "doc_id", "n_shingles", "sig"])
                at += len(sets)

    return docs.mapInArrow(run, SIG)


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        pw = Powers()
        for batch in batches:
            for sets in grouped((s for s in shingle_sets(batch.column(1), pw) if len(s)), len, 200_000):
                yield pa.RecordBatch.from_arrays([*set_ids(sets), pa.array([s.tobytes() for s in sets], pa.binary())], [*SET_ID, "set"])

    return docs.mapInArrow(run, "set_a long, set_b long, set binary")


class Forest:
    """Union-find over the members of one cell."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int):
        self.parent[self.find(i)] = self.find(j)


def linked_in_cell(table: pa.Table) -> pa.Table:
    """Confirmed links of one cell, enough to connect what its links connect."""
    table = table.sort_by("cluster")
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    sid, n, mine, home, cluster = (table[c].to_numpy() for c in ("sid", "n_shingles", "mine", "home", "cluster"))
    sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    forest, out = Forest(len(sid)), []
    bounds = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1], [True])))
    for f, t in zip(bounds[:-1], bounds[1:]):
        here = np.arange(f, t)
        a, b = here[mine[f:t] == i], here[mine[f:t] == j]
        for x in a.tolist():
            y = b[(b > x) if i == j else slice(None)]
            # a pair of two visitors belongs to the next size class
            y = y[(home[y] | home[x]) & (100 * np.minimum(n[x], n[y]) >= 75 * np.maximum(n[x], n[y]))]
            same = (sig[y] == sig[x]).sum(axis=1)
            y, same = y[same >= MATCHES], same[same >= MATCHES]
            for k in y[np.argsort(-same, kind="stable")].tolist():
                if forest.find(x) != forest.find(k):
                    shared = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
                    if 100 * shared >= 75 * (n[x] + n[k] - shared):
                        forest.join(x, k)
                        out.append((int(sid[x]), int(sid[k])))
    u, v = zip(*out) if out else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def cells(narrow: DataFrame, members: DataFrame) -> DataFrame:
    """Members (sid, cluster, n_shingles, sig, set; ``narrow`` has them without sets) dealt to cells that together
    hold every pair of a cluster whose sizes allow a link.  Small clusters share a
    cell.  A large one is split by size class (a factor of 4/3 each; a member visits
    the class below its own) and then into blocks that meet two by two."""
    size = narrow.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    small = (F.col("members") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    size = cut(size.withColumn("small", small))
    together = size.filter("small").agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0] // BLOCK_SHINGLES + 1
    rows = members.join(size.select("cluster", "small"), "cluster")
    plain = rows.filter("small").withColumn("cell", F.pmod(F.xxhash64("cluster"), F.lit(together))).select(
        "cell", F.lit(-1).alias("class"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("mine"), F.lit(True).alias("home"),
        "cluster", "sid", "n_shingles", "sig", "set")
    own = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(np.log(4 / 3)))).cast("int")
    big = rows.filter("not small").withColumn("own", own)
    big = big.withColumn("class", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("home", F.col("own") == F.col("class"))
    of_class = big.groupBy("cluster", "class").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.max("home").alias("any")).filter("any")
    big = big.join(of_class, ["cluster", "class"]).withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("cluster").alias("cell"), "class", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "home",
        "cluster", "sid", "n_shingles", "sig", "set")
    return plain.unionByName(big)


def with_set_ids(docs: DataFrame) -> DataFrame:
    """(set_a, set_b, row): each document's set, as ``near_duplicates`` numbers them, and the document as a struct."""
    def run(batches):
        pw = Powers()
        for batch in batches:
            at = 0
            for sets in grouped(shingle_sets(batch.column(0), pw), len, 200_000):
                yield pa.RecordBatch.from_arrays([*set_ids(sets), batch.column(1).slice(at, len(sets))], [*SET_ID, "row"])
                at += len(sets)

    rows = small_batches(docs).select(F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, f"set_a long, set_b long, {ddl_of([rows.schema['row']])}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and with ``sets`` its set's identifier
    (``set_a``, ``set_b``) and the number of its group of linked sets, ``group``."""
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(sign(texts))
    known = signed.filter("set_a IS NOT NULL AND doc_id IS NOT NULL")
    # numbered as they are written: no two classes share a number
    reps = cut(known.groupBy(*SET_ID).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                          F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
               .withColumn("sid", F.monotonically_increasing_id()))

    # posting lists, and of each class the rarest of its shared pairs
    posted = reps.select("sid", F.posexplode("sig").alias("coord", "low")).select(
        "sid", F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    prefix = cut(posted.join(sizes, "key").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("shared"))
                 .filter(F.size("shared") >= MATCHES)
                 .select("sid", F.explode(F.slice("shared", F.lit(1), F.size("shared") - MATCHES + 1)).alias("p")).select("sid", "p.key"))

    # clusters of classes that share a list
    least = prefix.groupBy("key").agg(F.min("sid").alias("v"))
    cluster = components(prefix.join(least, "key").select(F.col("sid").alias("u"), "v"))
    members = cut(cluster.select(F.col("node").alias("sid"), F.col("label").alias("cluster")).join(
        reps.select("sid", *SET_ID, "rep", "n_shingles", "sig"), "sid"))
    met = members.drop("rep").join(_sets_of(members, texts), SET_ID)
    links = cut(cells(members, met).groupBy("cell", "class", "i", "j").applyInArrow(linked_in_cell, "u long, v long"))
    label = components(links)

    # smallest identifier of each component, then of each document
    linked = label.join(reps.select(F.col("sid").alias("node"), "rep"), "node")
    lowest = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = label.join(lowest, "label").select(F.col("node").alias("sid"), "component_id", "label")
    of_class = reps.select("sid", *SET_ID, "rep", F.col("copies").alias("n")).join(of_class, "sid", "left")
    if not sets:
        of_class = of_class.filter("n > 1 OR component_id IS NOT NULL")
    of_class = of_class.select(*SET_ID, "n", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("label", "sid").alias("group"))
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    found = hot_join(signed.select("doc_id", "n_shingles", *SET_ID), of_class, SET_ID, signed.count(), how="left")
    return found.select(*([*SET_ID, "group"] if sets else []), "doc_id", "n_shingles", mine.alias("component_id"),
                        F.col("doc_id").eqNullSafe(mine).alias("kept"))


def _sets_of(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(set_a, set_b, set) of all members, made again from one document of each."""
    wanted = members.select(F.col("rep").alias("doc_id"))
    if wanted.count() <= MAX_WANTED:  # 8 bytes each; beyond it the texts are shuffled to their identifiers
        wanted = F.broadcast(wanted)
    return full_sets(texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text")).dropDuplicates(SET_ID)
