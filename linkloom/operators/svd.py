"""Randomized truncated SVD of the TF-IDF long table (F9), all sites in one job.

X is docs x terms, stored long as (site, url, idx, w) with idx below the site's
vocabulary cap T, so a terms x l matrix of a site is bounded.  Subspace iteration
on the term side with a Rayleigh-Ritz step (Halko, Martinsson & Tropp 2011):

    Z = orth(Omega);  repeat: W = X^T (X Z);  Z = orth(W)
    at the end  Z^T W = (X Z)^T (X Z) = V S^2 V^T  and  U S = X (Z V)

The number of jobs depends on the rounds and not on the sites:

* documents are grouped once into (site, salt, url, idx[], w[]) rows, hash-partitioned
  by (site, salt) and checkpointed that way; a salt holds about ``ENTRIES`` entries, so a
  large site is many groups;
* a round cogroups them with the site's Z, one copy per salt, and multiplies in NumPy
  by pieces of ``PIECE`` entries; partial rows of W are added up in a tree, ``FAN`` salts of
  ``BLOCK`` terms a task;
* a site's Z and W (T x l) meet in one task for the orthogonalisation.

Nothing goes through the driver.  Signs are arbitrary for an SVD; here the entry of
largest magnitude of each direction of terms is positive.  A site without terms has
no rows; a site of rank below the components asked for has zeros in the rest.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut, cut_by, discard, partitions_for
from linkloom.operators.joins import site_join, stored_bytes

ENTRIES = 1_000_000  # entries of X in a (site, salt) group
PIECE = 1 << 15      # entries multiplied at a time
FAN, BLOCK = 32, 256  # partial products added up by a task, and rows of each

MATRIX = pa.schema([("site", pa.string()), ("idx", pa.int32()), ("k", pa.int32()), ("z", pa.list_(pa.float64()))])
MATRIX_SQL = "site string, idx int, k int, z array<double>"
PARTIAL = MATRIX.append(pa.field("salt", pa.int32()))
PARTIAL_SQL = MATRIX_SQL + ", salt int"


def _shapes(docs: DataFrame, vocab: DataFrame, cap: int, oversample: int) -> DataFrame:
    """(site, k, l, salts): components, width of the iterated matrix and groups of documents of each site."""
    docs = docs.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("e")).alias("entries"))
    both = docs.join(vocab.groupBy("site").agg(F.max("rank").alias("t")), "site")
    k = F.least(F.lit(cap), F.greatest(F.lit(2), F.least("n", "t") - 1))
    return both.select("site", k.cast("int").alias("k"), F.least(k + oversample, F.col("t"), F.col("n")).cast("int").alias("l"),
                       (F.floor(F.col("entries") / ENTRIES) + 1).cast("int").alias("salts"))


def _matrix(site: str, idx: np.ndarray, k: int, z: np.ndarray) -> pa.Table:
    flat = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], np.ascontiguousarray(z).ravel())
    return pa.Table.from_arrays([pa.array([site] * len(z), pa.string()), pa.array(idx, pa.int32()), pa.array(np.full(len(z), k), pa.int32()), flat], schema=MATRIX)


def _dense(table: pa.Table, column: str = "z") -> tuple[np.ndarray, np.ndarray]:
    """(idx, rows) of one site's matrix."""
    z = table[column].combine_chunks()
    flat = z.flatten().to_numpy(zero_copy_only=False)
    return table["idx"].to_numpy(), flat.reshape(len(table), -1) if len(table) else flat.reshape(0, 1)


def _spread_rows(idx: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = np.zeros((int(idx.max()) + 1 if len(idx) else 0, z.shape[1]))
    out[idx] = z
    return out


def _pieces(docs: pa.Table):
    """(first document, starts, idx, w) of runs of whole documents, about PIECE entries each."""
    idx, w = docs["idx"].combine_chunks(), docs["w"].combine_chunks()
    ends = np.cumsum(idx.value_lengths().to_numpy(zero_copy_only=False))
    terms, values = idx.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        starts = np.concatenate(([0], ends[first:last - 1] - base))
        yield first, starts, terms[base:ends[last - 1]], values[base:ends[last - 1]]
        first = last


def _start(seed: int, oversized: str = "l"):
    def run(table: pa.Table) -> pa.Table:
        site, k, l = (table[c][0].as_py() for c in ("site", "k", oversized))
        idx = np.sort(table["idx"].to_numpy())
        rng = np.random.default_rng([seed, zlib.crc32((site or "").encode())])
        z, _ = np.linalg.qr(rng.standard_normal((len(idx), l)))
        return _matrix(site, idx, k, z)
    return run


def _partial(docs: pa.Table, z: pa.Table) -> pa.Table:
    """A group's share of X^T (X Z), as rows of terms that occur in it."""
    if not len(docs) or not len(z):
        return PARTIAL.empty_table()
    site, k, salt = z["site"][0].as_py(), z["k"][0].as_py(), docs["salt"][0].as_py()
    m = _spread_rows(*_dense(z))
    out = np.zeros_like(m)
    for _, starts, idx, w in _pieces(docs):
        y = np.add.reduceat(w[:, None] * m[idx], starts, axis=0)
        rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(idx))))
        order = np.argsort(idx, kind="stable")
        terms, at = np.unique(idx[order], return_index=True)
        out[terms] += np.add.reduceat(w[order, None] * y[rows[order]], at, axis=0)
    seen = np.nonzero(out.any(axis=1))[0]
    return _salted(_matrix(site, seen, k, out[seen]), salt)


def _salted(matrix: pa.Table, salt: int) -> pa.Table:
    return matrix.append_column(PARTIAL.field("salt"), pa.array(np.full(len(matrix), salt), pa.int32()))


def _adder(fan: int):
    """Adds up the partial products of one block of terms from ``fan`` salts."""
    def run(table: pa.Table) -> pa.Table:
        idx, z = _dense(table)
        order = np.argsort(idx, kind="stable")
        terms, at = np.unique(idx[order], return_index=True)
        total = _matrix(table["site"][0].as_py(), terms, table["k"][0].as_py(), np.add.reduceat(z[order], at, axis=0))
        return _salted(total, table["salt"][0].as_py() // fan)
    return run


def _orthogonal(table: pa.Table) -> pa.Table:
    idx, w = _dense(table)
    order = np.argsort(idx)
    z, _ = np.linalg.qr(w[order])
    return _matrix(table["site"][0].as_py(), idx[order], table["k"][0].as_py(), z)


def _ritz(z: pa.Table, w: pa.Table) -> pa.Table:
    """Z V: the directions of terms, by falling singular value."""
    if not len(z) or not len(w):
        return MATRIX.empty_table()
    k = z["k"][0].as_py()
    a, b = _spread_rows(*_dense(z)), _spread_rows(*_dense(w))
    g = a[:len(b)].T @ b
    _, v = np.linalg.eigh((g + g.T) / 2)
    m = a @ v[:, ::-1][:, :k]
    m *= np.where(m[np.abs(m).argmax(axis=0), np.arange(m.shape[1])] < 0, -1.0, 1.0)
    return _matrix(z["site"][0].as_py(), np.arange(len(m)), k, m)


def _rows(url_type: pa.DataType):
    schema = pa.schema([("site", pa.string()), ("url", url_type), ("svd", pa.list_(pa.float64()))])

    def run(docs: pa.Table, z: pa.Table) -> pa.Table:
        if not len(docs) or not len(z):
            return schema.empty_table()
        m = _spread_rows(*_dense(z))
        y = np.concatenate([np.add.reduceat(w[:, None] * m[idx], starts, axis=0) for _, starts, idx, w in _pieces(docs)])
        svd = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], y.ravel())
        return pa.Table.from_arrays([docs["site"].combine_chunks(), docs["url"].combine_chunks(), svd], schema=schema)
    return run


def randomized_svd(weights: DataFrame, vocab: DataFrame, cap: int = 64, oversample: int = 10, n_iter: int = 7, seed: int = 42) -> DataFrame:
    """(site, url, term, w) and vocab (site, term, rank) -> (site, url, svd ARRAY<DOUBLE>), the rows of U * S.

    Components of a site: min(cap, max(2, min(documents, terms) - 1)).  ``rank`` counts a site's terms
    from 1; their number is bounded by the vocabulary cap, which bounds a task's memory."""
    from pyspark.sql.pandas.types import to_arrow_type

    url_type = weights.schema["url"].dataType
    voc = cut(vocab.select("site", "term", "rank"))
    entries = weights.join(voc, ["site", "term"]).select("site", "url", (F.col("rank") - 1).cast("int").alias("idx"), "w")
    held = cut(entries.groupBy("site", "url").agg(F.collect_list(F.struct("idx", "w")).alias("e")))
    shapes = cut(_shapes(held, voc, cap, oversample))
    salts, n_bytes = shapes.select("site", "salts"), stored_bytes(shapes)
    docs = site_join(held, salts, n_bytes)
    docs = docs.select("site", F.pmod(F.xxhash64("url"), F.col("salts")).cast("int").alias("salt"), "url", F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
    total, most = (int(x) for x in shapes.agg(F.coalesce(F.sum("salts"), F.lit(0)), F.coalesce(F.max("salts"), F.lit(0))).first())
    docs = cut_by(docs, partitions_for(weights.sparkSession, total, 4), ["site", "salt"])
    discard(held)

    terms = site_join(voc.select("site", (F.col("rank") - 1).cast("int").alias("idx")), shapes.select("site", "k", "l"), n_bytes, spread_key="idx")
    z = cut(terms.groupBy("site").applyInArrow(_start(seed), MATRIX_SQL))

    def meet(m: DataFrame, product, schema: str) -> DataFrame:
        each = site_join(m, salts, n_bytes, spread_key="idx")
        each = each.select("site", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "idx", "k", "z")
        return docs.groupBy("site", "salt").cogroup(each.groupBy("site", "salt")).applyInArrow(product, schema)

    def summed(m: DataFrame) -> DataFrame:
        part, left = meet(m, _partial, PARTIAL_SQL), most
        while left > 1:
            part = part.groupBy("site", F.floor(F.col("idx") / BLOCK).alias("block"), F.floor(F.col("salt") / FAN).alias("some")).applyInArrow(_adder(FAN), PARTIAL_SQL)
            left = -(-left // FAN)
        return part.drop("salt")

    for _ in range(n_iter):
        step = cut(summed(z).groupBy("site").applyInArrow(_orthogonal, MATRIX_SQL))
        discard(z)
        z = step
    m = cut(z.groupBy("site").cogroup(summed(z).groupBy("site")).applyInArrow(_ritz, MATRIX_SQL))
    discard(z)
    return meet(m, _rows(to_arrow_type(url_type)), f"site string, url {url_type.simpleString()}, svd array<double>")
