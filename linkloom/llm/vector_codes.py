"""Operator 12, vector code compression by member-resident Lloyd rounds.

Vectors become integers (component times ``scale``, rounded down) and are cut into
``positions`` parts.  Each part position has a codebook of ``entries`` integer vectors
that Lloyd rounds fit to all vectors.

Parts are rows that live with the entry they belong to: the first assignment deals them by
(position, entry, salt) and writes them there.  In a round, the owner of an entry sums the
parts that reside with it (salted sums, then one row per position and entry), the new
codebook goes to all tasks, each part is compared with it where it lies, and only the parts
that change their entry are shuffled to the new owner, as a table of their own.  A part is
resident in the one table where every later codebook has kept it, so nothing that stays is
ever written or moved again, and sums, distances and codes are exact integers.

Sizes: a codebook is positions x entries rows whatever the input; salts spread a popular
entry over tasks; a lost executor repeats at most the round it was in.

Defined cases: vectors that are null, or hold null or non-finite components, are dropped, as
are those whose length is not that of the smallest identifier's vector; integers beyond
+-2**26 count as that bound (distances of up to 511 components then fit 64 bits); a length that the
positions don't divide is filled up with zeros; fewer vectors than entries make a smaller
codebook; equal identifiers start in order of their components, null ones last; rows with
equal or null identifiers are coded one by one; null labels are one label; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.iterate import cut
from linkloom.operators.joins import join_side_table

BOUND = 1 << 26
EXACT = 1 << 20  # below this products of parts are exact in double precision
SALT_ROWS = 1 << 16  # parts of a popular entry that lie together
BATCH = 1 << 14  # parts compared at a time
PART = "part long, pos int, entry int, salt int, x array<int>"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest row of ``book`` for each row of ``x``; ties to the lower entry."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for f in range(0, len(x), BATCH):
        y = x[f:f + BATCH]
        if max(np.abs(y).max(initial=0), np.abs(book).max(initial=0)) < EXACT and x.shape[1] <= 1 << 10:
            c = book.astype(np.float64)
            d = (c * c).sum(1) - 2 * (y.astype(np.float64) @ c.T) + (y.astype(np.float64) ** 2).sum(1)[:, None]
            d = d.astype(np.int64)
        else:
            d = np.stack([((y - c) ** 2).sum(1) for c in book], 1)
        at[f:f + BATCH] = d.argmin(1)
        far[f:f + BATCH] = d.min(1)
    return at, far


def by_position(x: np.ndarray, pos: np.ndarray, book: np.ndarray):
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in range(len(book)):
        mine = pos == p
        at[mine], far[mine] = nearest(x[mine], book[p])
    return at, far


def components(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """Stored rows (part, vec_id, label, q) of the vectors without null or non-finite components."""
    v = F.col("v")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(
        F.greatest(F.lit(-4.0 * BOUND), F.least(F.lit(4.0 * BOUND), x.cast("double") * F.lit(float(scale))))))).cast("int"))
    return cut(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
               .filter(F.coalesce(usable, F.lit(False)))
               .select(F.monotonically_increasing_id().alias("part"), "vec_id", "label", whole.alias("q")))


class Lloyd:
    """The parts' tables, oldest first, and the codebooks; table g was dealt by codebook g."""

    def __init__(self, rows: DataFrame, book: np.ndarray, length: int):
        self.rows, self.books, self.length, self.width = rows, [book], length, book.shape[2]
        self.salts = max(1, -(-rows.count() // SALT_ROWS))
        self.tables: list[DataFrame] = []

    def deal(self, parts: DataFrame) -> None:
        self.tables.append(cut(parts.repartition("pos", "entry", "salt")))

    def first(self) -> None:
        """Every part goes to the owner of its nearest entry."""
        book, width, length, salts = self.books[0], self.width, self.length, self.salts

        def run(batches):
            for b in batches:
                part, q = b.column(0).to_numpy(), components(b.column(1), length)
                q = np.pad(q, ((0, 0), (0, len(book) * width - length)))
                for p in range(len(book)):
                    x = np.ascontiguousarray(q[:, p * width:(p + 1) * width])
                    at, _ = nearest(x, book[p])
                    yield batch_of(part, np.full(len(x), p), at, part % salts, x)

        self.deal(self.rows.select("part", "q").mapInArrow(run, PART))

    def resident(self, then, schema: str) -> DataFrame:
        """``then(part, pos, entry, salt, x)`` over the parts that still lie where each table put them."""
        books, width = self.books[:len(self.tables)], self.width

        def over(born: int):
            def run(batches):
                for b in batches:
                    part, pos, entry, salt = (b.column(i).to_numpy() for i in range(4))
                    x = components(b.column(4), width)
                    for book in books[born + 1:]:
                        stays = by_position(x, pos, book)[0] == entry
                        part, pos, entry, salt, x = part[stays], pos[stays], entry[stays], salt[stays], x[stays]
                    yield from then(part, pos, entry, salt, x)
            return run

        out = None
        for g, t in enumerate(self.tables):
            one = t.mapInArrow(over(g), schema)
            out = one if out is None else out.unionByName(one)
        return out

    def update(self) -> None:
        """Owners' sums of their resident parts make the next codebook; an entry without parts stays."""
        positions, entries = self.books[-1].shape[:2]

        def run(part, pos, entry, salt, x):
            key, back = np.unique((salt.astype(np.int64) * positions + pos) * entries + entry, return_inverse=True)
            total = np.zeros((len(key), x.shape[1]), np.int64)
            np.add.at(total, back, x)
            yield pa.RecordBatch.from_arrays([pa.array((key // entries % positions).astype(np.int32)), pa.array((key % entries).astype(np.int32)),
                                              pa.array((key // entries // positions).astype(np.int32)), pa.array(np.bincount(back, minlength=len(key))),
                                              lists(total, pa.int64())], ["pos", "entry", "salt", "n", "total"])

        one = self.resident(run, "pos int, entry int, salt int, n long, total array<long>")
        wide = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(self.width)]
        again = [F.sum(f"t{i}").alias(f"t{i}") for i in range(self.width)]
        sums = one.groupBy("pos", "entry", "salt").agg(F.sum("n").alias("n"), *wide).groupBy("pos", "entry").agg(F.sum("n").alias("n"), *again)
        book = self.books[-1].copy()
        for r in sums.collect():  # positions x entries rows at most
            book[r["pos"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(self.width)]
        self.books.append(book)

    def migrate(self) -> None:
        """Parts whose nearest entry changes go to its owner."""
        book = self.books[-1]

        def run(part, pos, entry, salt, x):
            at, _ = by_position(x, pos, book)
            goes = at != entry
            yield batch_of(part[goes], pos[goes], at[goes], salt[goes], x[goes])

        self.deal(self.resident(run, PART))


def lists(x: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).astype(kind.to_pandas_dtype())))


def batch_of(part, pos, entry, salt, x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), *(pa.array(v.astype(np.int32)) for v in (pos, entry, salt)), lists(x, pa.int32())],
                                      ["part", "pos", "entry", "salt", "x"])


def books_text(book: np.ndarray) -> str:
    return ",".join(map(str, book.reshape(-1).tolist()))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positions: int = 8,
             entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per kept vector: vec_id, code (hex), error, label_error, codebooks_sha256."""
    rows = integers(vectors, id_col, vector_col, label_col, scale)
    in_order = [F.col("vec_id").asc_nulls_last(), F.col("q")]
    smallest = rows.orderBy(*in_order).first()
    if smallest is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"),
                           F.lit("").alias("codebooks_sha256"))
    length = len(smallest["q"])
    rows = rows.filter(F.size("q") == length)
    start = rows.orderBy(*in_order).limit(entries).collect()
    width = max(1, -(-length // positions))
    book = np.zeros((positions, len(start), width), np.int64)
    for e, r in enumerate(start):
        book[:, e] = np.pad(np.array(r["q"], np.int64), (0, positions * width - length)).reshape(positions, width)

    state = Lloyd(rows, book, length)
    state.first()
    for r in range(rounds):
        if r:
            state.migrate()
        state.update()
    last = state.books[-1]

    def coded(part, pos, entry, salt, x):
        at, far = by_position(x, pos, last)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(far)],
                                         ["part", "pos", "entry", "far"])

    # the vectors' own row of each group carries identifier and label; the others are its parts
    parts = state.resident(coded, "part long, pos int, entry int, far long")
    own = rows.select("part", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("long").alias("far"), "vec_id", "label")
    every = own.unionByName(parts, allowMissingColumns=True)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("hex")))
    coded_rows = cut(every.groupBy("part").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"),
                                               F.array_join(F.array_sort(F.collect_list(entry)).getField("hex"), "").alias("code"),
                                               F.sum("far").alias("error")))
    key = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    coded_rows = coded_rows.select("part", "vec_id", "code", "error", *key)
    sums = coded_rows.groupBy("_none", "_label").agg(F.try_sum("error").alias("label_error"))
    return (join_side_table(coded_rows, sums, ["_none", "_label"], spread_key="part")
            .select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(books_text(last).encode()).hexdigest()).alias("codebooks_sha256")))
