"""Words of whole texts as 64-bit hashes, a column of texts at a time.

A word is a run of ``[^\\x20\\x09-\\x0D]``, with A-Z lower-cased.  Both rules are
about ASCII bytes, and UTF-8 never uses those inside a longer character, so the
functions work on the Arrow buffers directly: no Python object per word.

``word_chunks`` cuts a column into chunks of about a megabyte (a longer text is
one chunk by itself), which bounds the memory of a task whatever the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df):
    """Texts go to Python tasks some megabytes at a time, unless the session says otherwise."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES) == "67108864b":  # Spark's default
        conf.set(ARROW_BYTES, str(8 << 20))
    return df


def ddl_of(fields) -> str:
    """Schema text of the fields; names of any characters are quoted."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields]).toDDL()


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            self.up, self.down = powers(_BASE, n), powers(_INV, n)
        return self.up, self.down


class Words:
    """Words of consecutive texts: ``h`` their hashes, ``doc`` the text each is
    of, ``count`` words per text; ``begin``/``end`` byte positions in ``data``."""

    def __init__(self, data, bounds, begin, end, h):
        self.data, self.bounds, self.begin, self.end, self.h = data, bounds, begin, end, h
        self.n_docs = len(bounds) - 1
        first = np.searchsorted(begin, bounds)
        self.count = np.diff(first)
        self.first = first[:-1]
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def text(self, i: int) -> str:
        return bytes(self.data[self.begin[i]:self.end[i]]).decode("utf-8", "replace")


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, text boundaries) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, bounds


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return data | (((data - np.uint8(65)) < 26).astype(np.uint8) << np.uint8(5))


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) <= 4)


def words_of(data: np.ndarray, bounds: np.ndarray, pw: Powers, lower: bool = True) -> Words:
    data = data[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    if lower:
        data = lowered(data)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, bounds, none, none, none.astype(np.uint64))
    inside = ~spaces(data)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begin = np.flatnonzero(inside & (cut[:n] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = pw.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[:n]
    np.cumsum(terms, out=sums[1:])
    del terms
    h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
    return Words(data, bounds, begin, end, mix(h))


def word_chunks(column, lower: bool = True, size: int = CHUNK_BYTES, pw: Powers | None = None):
    """Yield (first row, Words) for successive runs of rows of about ``size`` bytes."""
    data, bounds = bytes_of(column)
    pw = pw or Powers()
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        to = min(n, max(to, at + 1))
        yield at, words_of(data, bounds[at:to + 1], pw, lower)
        at = to
    pa.default_memory_pool().release_unused()  # an idle worker would keep what a batch took


RESULTS = {"doc_id", "score", "predicted", "spans", "passages", "key_word", "n_tokens", "n_known", "train_tokens", "base_score"}


def no_clash(keep: tuple) -> None:
    """Columns that a scoring operator passes on can't have a result's name (a struct of them can)."""
    if clash := RESULTS & set(keep):
        raise ValueError(f"can't keep columns named like results: {sorted(clash)}")


def sums_by_key(keys: np.ndarray, weights: np.ndarray | None = None):
    """(distinct keys, their summed weights), int64."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


class Tally:
    """Counts by 64-bit key with bounded memory: ``add`` returns the counts to
    hand on whenever ``most`` distinct keys are held, else None."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.keys, self.counts, self.waiting, self.n = most, [], [], 0, 0

    def add(self, keys: np.ndarray):
        k, c = sums_by_key(keys)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.waiting += len(k)
        if self.waiting < self.most:
            return None
        k, c = self.take()
        if len(k) > self.most // 2:
            return k, c
        self.keys, self.counts, self.waiting = [k], [c], len(k)
        return None

    def take(self):
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        k, c = sums_by_key(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.waiting = [], [], 0
        return k, c
