"""Operator 11, cross-tokenizer alignment with inverted pair bitmaps.

Each text, after one space, is encoded by tokenizer A (byte-level BPE) and by B (pieces,
which adds that space itself).  Byte offsets where tokens of both end cut them into
groups, and the two tokens that end there are linked.

Documents are numbered within blocks of at most 2**15 rows or about ``BLOCK_BYTES`` of
text, all of one task.  A block's index holds, per linked id pair, one compressed bitmap
of its documents for each bit of the links' number (multiplicity planes): 16-bit numbers
where there are few, plain bits where there are many.  The chunks of a block are OR-merged
when it closes, and popcounts of the merged bitmaps give the pair's documents (all planes
together) and links (plane k counts 2**k).  Sums by pair over the blocks are the corpus
counts; the largest of each B id marks its best pairs.  The postings then meet their
pair's score and go back to their block, where they add it to the documents they hold:
a frequent pair is one row per block, never one group.

Both tokenizers work on units: a run of spaces and what follows up to the next space (or the text's end).
Neither joins text across such a border (A's pre-tokenizer cuts there, and no piece of B
has a space after another character, which is checked; otherwise a text is one unit), so a
worker encodes each distinct unit once, as far as its table (bounded) holds them, and the
groups of a text are those of its units.

Defined cases: texts that are null, empty, or whose joined token bytes differ from
space + text in A or B have no tokens: zeros and an empty checksum; strings of special
tokens are plain text; null or repeated identifiers are kept row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import Powers, bytes_of, mix, small_batches, sums_by_key
from linkloom.operators.iterate import cut
from linkloom.operators.joins import MAX_BROADCAST_BYTES, join_side_table, stored_bytes

CHUNK = 1 << 19  # bytes of text at a time
LOW = 15  # bits of a document's number in its block
BLOCK_BYTES = 16 << 20
DENSE = 1 << (LOW - 4)  # from so many documents on, plain bits are smaller than 16-bit numbers
DENSE_BYTES = 1 << (LOW - 3)
ID_BITS = 24
MOST_UNITS, MOST_STORED = 400_000, 32 << 20  # of a worker's table: units, bytes of their groups as text
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
INDEX = f"block long, low int, {DOC}, pair long, docs long, links long, planes array<binary>"
RESULT = f"{DOC}, n_best long, count_sum long"


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Units:
    """Units of consecutive texts, each text after one space: hash, text number, byte positions in ``data``."""

    def __init__(self, column, at: int, to: int, pw: Powers, whole: bool):
        data, bounds = bytes_of(column.slice(at, to - at))
        data, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
        self.sizes = np.diff(bounds)
        n = len(self.sizes)
        starts = bounds[:-1] + np.arange(n)  # where the added spaces stand
        self.data = np.full(len(data) + n, 32, np.uint8)
        own = np.ones(len(self.data), bool)
        own[starts] = False
        self.data[own] = data
        cuts = np.zeros(len(self.data) + 1, bool)
        cuts[starts] = True
        cuts[-1] = True
        if not whole:
            d = self.data
            before = d[:-1]
            ends = before > 32
            ends &= before != 127
            # a character of several bytes may be white space to A: a border only where its first bytes can't begin one
            for i in (2, 3):
                lead = np.zeros(len(before), bool)
                lead[i - 1:] = np.isin(d[:len(before) - i + 1], [[0xC2], [0xE1, 0xE2, 0xE3]][i - 2])
                ends &= ~(lead & (before >= 0x80))
            cuts[1:-1] |= ends & (d[1:] == 32)
            # spaces at a text's end stay with the unit before them: B encodes nothing but its own space as nothing
            edge = np.flatnonzero(cuts)
            rest = np.concatenate(([0], np.cumsum(d != 32)))
            bare = edge[:-1][np.diff(rest[edge]) == 0]
            cuts[bare[~np.isin(bare, starts)]] = False
        edge = np.flatnonzero(cuts)
        self.begin, self.end = edge[:-1], edge[1:]
        up, down = pw.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:len(self.data)], out=sums[1:])
        self.h = mix((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))
        self.first = np.searchsorted(self.begin, np.append(starts, len(self.data)))
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def text(self, i: int) -> str:
        return bytes(self.data[self.begin[i]:self.end[i]]).decode("utf-8")


def flat_gather(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs [start, start + n) of ``values``, one after the other."""
    total = np.concatenate(([0], np.cumsum(n)))
    return values[np.repeat(start - total[:-1], n) + np.arange(total[-1])]


class Tokens:
    """Bytes of each token id, one after the other."""

    def __init__(self, tokens: list):
        self.n = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return flat_gather(self.flat, self.start[ids], self.n[ids])


def flat_ids(lists: list) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    return np.concatenate((a, np.zeros((max(n - len(a), len(a)), *a.shape[1:]), a.dtype)))


class Aligner:
    """Groups and links by unit; a unit is encoded when first met."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = byte_of_char()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        names = [names.get(i, "") for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = Tokens([bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t in names])
        self.bytes_b = Tokens([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces])
        self.decimal = Tokens([str(i).encode() for i in range(max(len(names), len(pieces)))])
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    @classmethod
    def of_worker(cls, path_a: str, path_b: str):
        """The Python worker's table for these files: tasks that a worker runs one after the other go on with it."""
        import tokenizers

        held = tokenizers.__dict__.setdefault("_aligners_by_paths", {})
        if (path_a, path_b) not in held:
            held[path_a, path_b] = cls(path_a, path_b)
        return held[path_a, path_b]

    def clear(self):
        self.h, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # per unit: place and length of its groups as text and of its links; tokens of A, of B; whether bytes agree
        self.facts = np.zeros((1 << 12, 7), np.int64)
        self.text, self.links = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.uint64)
        self.n_text = self.n_links = 0

    def align(self, units: Units, at: np.ndarray):
        """Facts of the units ``at`` (as above), their groups as text and their links, one after the other."""
        texts = [units.text(i) for i in at]
        ids_a, n_a = flat_ids([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        ids_b, n_b = flat_ids(self.b.encode([t[1:] for t in texts], num_threads=1))
        size, count = units.end[at] - units.begin[at], len(at)
        good = np.ones(count, bool)
        for ids, n, tokens in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            of = np.repeat(np.arange(count), n)
            good &= np.bincount(of, tokens.n[ids], count) == size
        for ids, n, tokens in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            mine = good[np.repeat(np.arange(count), n)]
            same = tokens.of(ids[mine]) == flat_gather(units.data, units.begin[at][good], size[good])
            good[np.flatnonzero(good)] = np.bincount(np.repeat(np.arange(good.sum()), size[good]), ~same, good.sum()) == 0
        of_a, of_b = (np.repeat(np.arange(count), n) for n in (n_a, n_b))
        ids_a, ids_b, of_a, of_b = ids_a[good[of_a]], ids_b[good[of_b]], of_a[good[of_a]], of_b[good[of_b]]
        # both tokenisations cover the same bytes, so ends agree over all units at once
        end_a, end_b = np.cumsum(self.bytes_a.n[ids_a]), np.cumsum(self.bytes_b.n[ids_b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        last_a = ends[group_a] == end_a if len(ends) else np.zeros(0, bool)
        last_b = ends[group_b] == end_b if len(ends) else np.zeros(0, bool)
        links = ids_a[last_a].astype(np.uint64) << np.uint64(ID_BITS) | ids_b[last_b].astype(np.uint64)
        n_links = np.bincount(of_a[last_a], minlength=count)
        # ids as text in order: a group's tokens of A, then those of B, each with the mark that follows it
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        ids, of, mark = (np.zeros(len(ids_a) + len(ids_b), k) for k in (np.int64, np.int64, np.uint8))
        ids[place_a], ids[place_b], of[place_a], of[place_b] = ids_a, ids_b, of_a, of_b
        mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        long = self.decimal.n[ids]
        to = np.cumsum(long + 1)
        text = np.zeros(to[-1] if len(to) else 0, np.uint8)
        digits = np.ones(len(text), bool)
        digits[to - 1] = False
        text[to - 1], text[digits] = mark, self.decimal.of(ids)
        n_text = np.bincount(of, long + 1, count).astype(np.int64)
        facts = np.stack((np.cumsum(n_text) - n_text, n_text, np.cumsum(n_links) - n_links, n_links, n_a, n_b, good), 1).astype(np.int64)
        return facts, text, links

    def _learn(self, units: Units, h: np.ndarray, at: np.ndarray):
        facts, text, links = self.align(units, at)
        facts[:, 0] += self.n_text
        facts[:, 2] += self.n_links
        self.facts = grown(self.facts, len(self.h) + len(h))
        self.facts[len(self.h):len(self.h) + len(h)] = facts
        self.text, self.links = grown(self.text, self.n_text + len(text)), grown(self.links, self.n_links + len(links))
        self.text[self.n_text:self.n_text + len(text)] = text
        self.links[self.n_links:self.n_links + len(links)] = links
        self.n_text, self.n_links = self.n_text + len(text), self.n_links + len(links)
        place = np.searchsorted(self.h, h)
        self.row = np.insert(self.row, place, np.arange(len(self.h), len(self.h) + len(h)))
        self.h = np.insert(self.h, place, h)

    def documents(self, units: Units):
        """Per text: tokens of A and B, groups, checksum; and (pair, text) of every link."""
        if len(self.h) > MOST_UNITS or self.n_text > MOST_STORED:
            self.clear()
        h, first, back = np.unique(units.h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        new = np.ones(len(h), bool) if not len(self.h) else self.h[at] != h
        if new.any():
            self._learn(units, h[new], first[new])
            at = np.searchsorted(self.h, h)
        f = self.facts[self.row[at]][back]
        good = (np.bincount(units.doc, f[:, 6] == 0, len(units.sizes)) == 0) & (units.sizes > 0)
        f[~good[units.doc], 1:6:2] = f[~good[units.doc], 4:5] = 0
        sums = np.zeros((len(f) + 1, 7), np.int64)
        np.cumsum(f, axis=0, out=sums[1:])
        per = sums[units.first[1:]] - sums[units.first[:-1]]
        text, ends = memoryview(flat_gather(self.text, f[:, 0], f[:, 1])), sums[units.first, 1].tolist()
        sha = [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:])]
        return per[:, 4], per[:, 5], per[:, 3], sha, flat_gather(self.links, f[:, 2], f[:, 3]), np.repeat(units.doc, f[:, 3])


def bitmaps(keys: np.ndarray, times: np.ndarray):
    """Postings of a block from its distinct keys (pair << LOW | document), sorted, with their number of links.
    Gives pairs, documents, links, and the planes as an Arrow list of compressed bitmaps."""
    pair, low = keys >> np.uint64(LOW), (keys & np.uint64((1 << LOW) - 1)).astype(np.uint16)
    begin = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(pair))))
    planes = max(1, int(times.max(initial=1)).bit_length())
    high = np.zeros(len(begin), np.int64)  # planes of each pair
    count, which, rows = [], [], []
    for k in range(planes):
        has = np.flatnonzero(times >> k & 1)
        n = np.bincount(group[has], minlength=len(begin))
        high[n > 0] = k + 1
        count.append(n)
        rows.append(low[has])
    links = sum((n << k for k, n in enumerate(count)), np.zeros(len(begin), np.int64))
    offsets = np.concatenate(([0], np.cumsum(high)))
    n = np.zeros(offsets[-1], np.int64)
    source = np.zeros(offsets[-1], np.int64)  # where a bitmap's documents begin in the planes one after the other
    base = 0
    for k in range(planes):
        mine = np.flatnonzero(high > k)
        n[offsets[mine] + k] = count[k][mine]
        source[offsets[mine] + k] = base + (np.cumsum(count[k]) - count[k])[mine]
        base += len(rows[k])
    every = np.concatenate(rows) if rows else np.zeros(0, np.uint16)
    size = np.where(n < DENSE, 2 * n, DENSE_BYTES)
    ends = np.concatenate(([0], np.cumsum(size)))
    data = np.zeros(ends[-1], np.uint8)
    few = n < DENSE
    short = flat_gather(every, source[few], n[few])
    data.view(np.uint16)[np.repeat(ends[:-1][few] // 2 - (np.cumsum(n[few]) - n[few]), n[few]) + np.arange(len(short))] = short
    for i in np.flatnonzero(~few).tolist():
        bits = np.zeros(1 << LOW, bool)
        bits[every[source[i]:source[i] + n[i]]] = True
        data[ends[i]:ends[i + 1]] = np.packbits(bits)
    flat = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return pair[begin].view(np.int64), np.diff(np.append(begin, len(pair))), links, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def read_bitmaps(planes: pa.ListArray):
    """(row, document, links that this plane stands for) of every set bit."""
    if isinstance(planes, pa.ChunkedArray):
        planes = planes.combine_chunks()
    flat = planes.flatten()
    held = np.diff(planes.offsets.to_numpy())
    row = np.repeat(np.arange(len(planes)), held)
    worth = np.int64(1) << (np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held))
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    few = size < DENSE_BYTES
    raw = flat_gather(data, offsets[:-1][few].astype(np.int64), size[few].astype(np.int64)).view(np.uint16)
    rows, lows, worths = [np.repeat(row[few], size[few] // 2)], [raw.astype(np.int64)], [np.repeat(worth[few], size[few] // 2)]
    for i in np.flatnonzero(~few).tolist():
        got = np.flatnonzero(np.unpackbits(data[offsets[i]:offsets[i + 1]]))
        rows.append(np.full(len(got), row[i]))
        lows.append(got)
        worths.append(np.full(len(got), worth[i]))
    return np.concatenate(rows), np.concatenate(lows), np.concatenate(worths)


def index(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of two kinds of rows: documents (block, low, counts, checksum; pair is null) and
    postings (block, pair, docs, links, planes)."""
    names = [x.strip().split()[0] for x in INDEX.split(", ")]
    kinds = {"low": pa.int32(), "groups_sha256": pa.string(), "planes": pa.list_(pa.binary())}

    def rows(n: int, **held):
        return pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names)

    def run(batches):
        known, pw = Aligner.of_worker(path_a, path_b), Powers()
        block, low, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def closed():
            keys, times = sums_by_key(np.concatenate([k for k, _ in held]), np.concatenate([t for _, t in held])) if held else (
                np.zeros(0, np.uint64), np.zeros(0, np.int64))
            pair, n, links, planes = bitmaps(keys, times)
            for f in range(0, len(pair), 100_000):
                t = min(len(pair), f + 100_000)
                yield rows(t - f, block=pa.array(np.full(t - f, block)), pair=pa.array(pair[f:t]), docs=pa.array(n[f:t]),
                           links=pa.array(links[f:t]), planes=planes.slice(f, t - f))

        for batch in batches:
            bounds, at, n = bytes_of(batch.column(1))[1], 0, batch.num_rows
            while at < n:
                if low and (low == 1 << LOW or size >= BLOCK_BYTES):
                    yield from closed()
                    block, low, size, held = block + 1, 0, 0, []
                to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1), at + (1 << LOW) - low)
                units = Units(batch.column(1), at, to, pw, known.whole)
                n_a, n_b, n_groups, sha, pair, of = known.documents(units)
                k, c = np.unique(pair << np.uint64(LOW) | (of + low).astype(np.uint64), return_counts=True)
                held.append((k, c.astype(np.int64)))
                yield rows(to - at, block=pa.array(np.full(to - at, block)), low=pa.array(np.arange(low, low + to - at, dtype=np.int32)),
                           doc_id=batch.column(0).slice(at, to - at), n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups),
                           n_links=pa.array(n_groups), groups_sha256=pa.array(sha, pa.string()))
                low, size, at = low + to - at, size + int(bounds[to] - bounds[at]), to
        yield from closed()
        pa.default_memory_pool().release_unused()

    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(texts.mapInArrow(run, INDEX))


def pair_scores(indexed: DataFrame) -> DataFrame:
    """One stored row per linked pair: pair, a, b, docs, links, best (no pair of this B id has more links)."""
    counts = cut(indexed.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
                 .select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"), "docs", "links"))
    top = counts.groupBy("b").agg(F.max("links").alias("top"))
    return cut(join_side_table(counts, top, ["b"], spread_key="pair").select("pair", "a", "b", "docs", "links", (F.col("links") == F.col("top")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    indexed = index(docs, path_a, path_b, id_col, text_col)
    scores = pair_scores(indexed).select("pair", F.col("links").alias("count"), "best")
    posts = indexed.filter("pair IS NOT NULL").select("block", "pair", "planes")
    small = stored_bytes(scores) <= MAX_BROADCAST_BYTES
    posts = posts.join(F.broadcast(scores) if small else scores, "pair").select("block", "planes", "count", "best")
    names = [x.strip().split()[0] for x in DOC.split(", ")]
    rows = indexed.filter("pair IS NULL").select(F.col("block").alias("of"), "low", *names)

    def returned(left, right):
        low, best, total = left["low"].to_numpy(), np.zeros(1 << LOW, np.int64), np.zeros(1 << LOW, np.int64)
        if right.num_rows:
            count, top = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
            row, doc, times = read_bitmaps(right["planes"])
            np.add.at(total, doc, times * count[row])
            np.add.at(best, doc, times * top[row])
        return pa.table([*(left[c] for c in names), pa.array(best[low]), pa.array(total[low])], names=[*names, "n_best", "count_sum"])

    return rows.groupBy("of").cogroup(posts.groupBy("block")).applyInArrow(returned, RESULT)
