"""Operator 6, packing token sequences first-fit decreasing.

Documents are tokenised where they lie.  Every full ``size`` tokens of a document
are a sequence of their own; only the rests (shorter than a sequence) travel, as
16-bit ids where the vocabulary allows it, to randomised groups of about
``group_docs`` documents, which are packed independently.

In a group the rests are placed longest first, each into the first bin with room,
found by walking down a tournament tree of the bins' free capacities.  Then gaps
of at least ``least_piece`` tokens are filled from the emptiest bins, cutting
documents where a gap ends, so that one bin of a group is left partly full; it is
cut into sequences whose lengths are powers of two, which need no padding.

Words are tokenised once per worker, as far as its table of words (bounded) holds them: a vocabulary whose pre-tokeniser never joins
text across white space gives the same ids word by word.  ``by_word=False``
tokenises whole texts for any other.

Defined cases: null text is empty, and an empty text is the end id alone; a
document of any length is cut as above; rows with equal or null identifiers are
packed one by one (groups are dealt by identifier and row number); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import Powers, bytes_of, small_batches, word_chunks

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long, sequence_length long")
MOST_WORDS = 1_000_000  # about 50 MB of a worker


class WordIds:
    """Token ids by word hash; a word is tokenised when first met in a task."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self):
        self.h = np.zeros(0, np.uint64)
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    @classmethod
    def of_worker(cls, path: str):
        """The Python worker's table for this vocabulary file: tasks that a worker runs one
        after the other go on with it.  It lives on the tokenizer library's module, since
        this one travels to the workers by value."""
        import tokenizers

        held = tokenizers.__dict__.setdefault("_words_by_path", {})
        if path not in held:
            held[path] = cls(tokenizers.Tokenizer.from_file(path))
        return held[path]

    def _learn(self, words, h, at):
        got = self.tokenizer.encode_batch_fast([words.text(i) for i in at], add_special_tokens=False)
        lists = [e.ids for e in got]
        n = np.array([len(x) for x in lists], np.int64)
        new = np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum()))
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        self.ids[self.used:self.used + len(new)] = new
        start = self.used + np.cumsum(n) - n
        self.used += len(new)
        place = np.searchsorted(self.h, h)
        self.h, self.start, self.n = (np.insert(a, place, b) for a, b in ((self.h, h), (self.start, start), (self.n, n)))

    def documents(self, words, end_id: int):
        """(ids of all texts with their end ids, bounds per text)."""
        if len(self.h) > MOST_WORDS:
            self.clear()
        h, first, back = np.unique(words.h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        new = np.ones(len(h), bool) if not len(self.h) else self.h[at] != h
        if new.any():
            self._learn(words, h[new], first[new])
            at = np.searchsorted(self.h, h)
        start, n = self.start[at][back], self.n[at][back]
        total = np.concatenate(([0], np.cumsum(n)))
        flat = self.ids[np.repeat(start - total[:-1], n) + np.arange(total[-1])]
        ends = total[words.first + words.count]
        out = np.insert(flat, ends, end_id)
        return out, np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))


def whole_texts(column, tokenizer, end_id: int):
    data, bounds = bytes_of(column)
    for i in range(len(bounds) - 1):
        text = bytes(data[bounds[i]:bounds[i + 1]]).decode("utf-8")
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end_id], np.uint32)
        yield ids, np.array([0, len(ids)])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def first_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins as lists of item numbers; ``lengths`` must not increase."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [size] * (2 * leaves)  # node i is the larger of its children 2i and 2i + 1
    bins: list[list[int]] = []
    for item, need in enumerate(lengths.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(item)
        room[at] -= need
        while at > 1:
            at //= 2
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
    return bins


def filled(bins: list[list[int]], lengths, size: int, least_piece: int) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (item, from, to): gaps filled from the emptiest bins, the last
    partly full bin cut at powers of two."""
    pieces = [[(i, 0, int(lengths[i])) for i in b] for b in bins]
    load = [sum(t - f for _, f, t in p) for p in pieces]
    order = sorted(range(len(bins)), key=lambda b: -load[b])
    hi, lo = 0, len(order) - 1
    while hi < lo:
        into, out = order[hi], order[lo]
        gap = size - load[into]
        if gap < least_piece:
            hi += 1
            continue
        item, f, t = pieces[out].pop()
        take = min(gap, t - f)
        pieces[into].append((item, f, f + take))
        if take < t - f:
            pieces[out].append((item, f + take, t))
        load[into] += take
        load[out] -= take
        if not load[out]:
            lo -= 1
    out = []
    for b in order:
        left = load[b]
        if left and size - left >= least_piece:
            rest = pieces[b][::-1]
            while left:
                want = 1 << (left.bit_length() - 1)
                left -= want
                run = []
                while want:
                    item, f, t = rest.pop()
                    take = min(want, t - f)
                    run.append((item, f, f + take))
                    if take < t - f:
                        rest.append((item, f + take, t))
                    want -= take
                out.append(run)
        elif left:
            out.append(pieces[b])
    return out


def tokenised(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, by_word: bool) -> DataFrame:
    """doc_id, turn (row number in the task), doc_tokens, full (checksums of the full sequences), rest (ids)."""
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        known = WordIds.of_worker(tokenizer_path)
        tokenizer = known.tokenizer
        kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        pw, turn = Powers(), 0
        for batch in batches:
            at = 0
            if by_word:
                chunks = (known.documents(w, end_id) for _, w in word_chunks(batch.column(1), lower=False, pw=pw))
            else:
                chunks = whole_texts(batch.column(1), tokenizer, end_id)
            for ids, bounds in chunks:
                tokens, full, rest = np.diff(bounds), [], []
                for f, t in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    cut_at = f + (t - f) // size * size
                    full.append([crc(ids[k:k + size]) for k in range(f, cut_at, size)])
                    rest.append(ids[cut_at:t].astype(kind).tobytes())
                n = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.arange(turn, turn + n)), pa.array(tokens),
                     pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array([kind.itemsize] * n, pa.int32())],
                    ["doc_id", "turn", "doc_tokens", "full", "rest", "width"])
                at, turn = at + n, turn + n

    return docs.mapInArrow(run, "doc_id long, turn long, doc_tokens long, full array<long>, rest binary, width int")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
         end_id: int = 1, group_docs: int = 4096, least_piece: int = 16, by_word: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    groups = max(1, -(-docs.count() // group_docs))
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = tokenised(texts, tokenizer_path, size, end_id, by_word)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "turn"), F.lit(groups)))

    def run(table):
        ids_of = table["doc_id"].to_pylist()
        tokens, turn = table["doc_tokens"].to_numpy(), table["turn"].to_numpy()
        rest = [np.frombuffer(r, "<u2" if w == 2 else "<u4") for r, w in zip(table["rest"].to_pylist(), table["width"].to_pylist())]
        out, seq = [], table["grp"][0].as_py() << 32
        for d, sums in enumerate(table["full"].to_pylist()):
            for k, c in enumerate(sums):
                out.append((ids_of[d], k * size, size, c, int(tokens[d]), seq, 0, size))
                seq += 1
        lengths = np.array([len(r) for r in rest])
        order = np.lexsort((turn, -lengths))
        order = order[lengths[order] > 0]
        for run_of in filled(first_fit_decreasing(lengths[order], size), lengths[order], size, least_piece):
            offset, total = 0, sum(t - f for _, f, t in run_of)
            for item, f, t in run_of:
                d = int(order[item])
                begin = int(tokens[d]) - len(rest[d])
                out.append((ids_of[d], begin + f, t - f, crc(rest[d][f:t]), int(tokens[d]), seq, offset, total))
                offset += t - f
            seq += 1
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*out) if out else [[]] * len(names))})

    return rows.groupBy("grp").applyInArrow(run, PIECE)
