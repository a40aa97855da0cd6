"""Operator 4, quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is described by
shares of its characters and words (case, digits, marks, word lengths, repeats
within the passage and of earlier text) and encoded by a small learned layer.
Gated attention, learned from document labels alone, weighs the passages, and a
logistic output scores the weighted representation, so a document can be judged
by the passages that matter.

Fitting reads a sample of at most ``max_train`` labelled documents, chosen by
hash, as passage features; scoring reads all documents.  The model is a few
thousand numbers.

Defined cases: null text is empty, and a text without words is one passage with
all features zero; labels that are null are ignored, a document labelled more
than once counts by its highest label; with labels of one kind only the score is
that share; rows with equal identifiers are scored one by one; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import Powers, ddl_of, mix, no_clash, small_batches, word_chunks
from linkloom.operators.iterate import cut

PASSAGE = 64
FEATURES = 24


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
MARKS = bytes(b for b in range(33, 127) if b not in LETTERS + DIGITS)
# kinds of bytes whose number per passage is counted
KINDS = [_table(k) for k in (bytes(range(65, 91)), LETTERS, DIGITS, MARKS, b"!?", b"|<>{}[]=\\", b"#$%&*+@^_~", b".", b",;:",
                             b"\"'()", bytes(range(128, 256)))]


def passages(w) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, bounds of passages per text) of one chunk of words."""
    n_words = len(w.h)
    per_doc = np.maximum(1, -(-w.count // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(per_doc)))
    out = np.zeros((bounds[-1], FEATURES), np.float32)
    if not n_words:
        return out, bounds
    place = np.arange(n_words) - w.first[w.doc]
    passage = bounds[w.doc] + place // PASSAGE
    starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    has = passage[starts]

    def total(x):
        return np.add.reduceat(x.astype(np.float64), starts)

    n = total(np.ones(n_words))
    length = w.end - w.begin
    chars = total(length)
    sums = []
    for kind in KINDS:
        c = np.concatenate(([0], np.cumsum(kind[w.data])))
        sums.append(c[w.end] - c[w.begin])
    kinds = [total(x) for x in sums]
    letters = np.maximum(kinds[1], 1)

    def seen_before(key):
        """Whether an equal key of the same text came earlier."""
        order = np.lexsort((np.arange(len(key)), key))
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        return again

    in_doc = seen_before(mix(w.h + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    in_passage = seen_before(mix(w.h + passage.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    run = np.zeros(n_words, bool)
    run[1:] = (w.h[1:] == w.h[:-1]) & (w.doc[1:] == w.doc[:-1])
    three = np.zeros(n_words, bool)
    if n_words > 2:
        key = mix(w.h[2:] * np.uint64(3) + w.h[1:-1] * np.uint64(5) + w.h[:-2] * np.uint64(7) + w.doc[2:].astype(np.uint64))
        three[2:] = seen_before(key) & (w.doc[2:] == w.doc[:-2])
    line = np.concatenate(([0], np.cumsum(w.data == 10)))
    gap = np.zeros(n_words)
    gap[1:] = np.where(w.doc[1:] == w.doc[:-1], line[w.begin[1:]] - line[w.end[:-1]], 0)
    mean = chars / n
    columns = [
        kinds[0] / letters, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / n, kinds[5] / n, kinds[6] / n,
        kinds[7] / n, kinds[8] / n, kinds[9] / n, kinds[10] / chars, mean / 10,
        np.sqrt(np.maximum(total(length.astype(np.float64) ** 2) / n - mean**2, 0)) / 10,
        total(length <= 3) / n, total(length > 14) / n, total(sums[1] + sums[10] == 0) / n, total(sums[0] >= np.maximum(length - 3, 2)) / n,
        total(in_doc) / n, total(in_passage) / n, total(run) / n, total(three) / n, np.minimum(total(gap) / n, 2),
        n / PASSAGE, np.log1p(w.count[w.doc[starts]]) / 10]
    out[has] = np.stack(columns, axis=1)
    return out, bounds


class Attention:
    """The network: encoder, gated attention, logistic output; trained with Adam."""

    def __init__(self, mean, sd, hidden: int = 24, gates: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        k = len(mean)
        self.p = {"W": rng.standard_normal((k, hidden)) / np.sqrt(k), "b": np.zeros(hidden), "V": rng.standard_normal((hidden, gates)) / np.sqrt(hidden),
                  "U": rng.standard_normal((hidden, gates)) / np.sqrt(hidden), "w": np.zeros(gates), "c": np.zeros(hidden), "d": np.zeros(1)}

    def forward(self, x, starts, of):
        p = self.p
        x = np.clip((x - self.mean) / self.sd, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        e = np.exp(np.clip(e - np.maximum.reduceat(e, starts)[of], -50, 0))
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return y, (x, h, t, g, a, z)

    def gradients(self, x, starts, of, target):
        p = self.p
        y, (x, h, t, g, a, z) = self.forward(x, starts, of)
        dy = (y - target) / len(target)
        dz = dy[:, None] * p["c"]
        da = (h * dz[of]).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[of])
        dtg = de[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}

    def train(self, x, bounds, y, epochs: int, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, max(1, epochs * -(-len(y) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at:at + batch]
                n = bounds[docs + 1] - bounds[docs]
                starts = np.cumsum(n) - n
                rows = np.repeat(bounds[docs] - starts, n) + np.arange(n.sum())
                grad = self.gradients(x[rows], starts, np.repeat(np.arange(len(docs)), n), y[docs])
                step += 1
                speed = rate * (1 - step / (steps + 1))
                for k, v in self.p.items():
                    gk = grad[k] + decay * v
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    s[k] = 0.999 * s[k] + 0.001 * gk * gk
                    v -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        max_train: int = 8_000, epochs: int = 15) -> Attention:
    small_batches(docs)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    part = min(1.0, max_train / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(part * (1 << 20)))
    # max_train small rows: the bound of the broadcast
    sample = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id"))

    def run(batches):
        pw = Powers()
        for b in batches:
            for at, w in word_chunks(b.column(0), lower=False, pw=pw):
                x, bounds = passages(w)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(at, w.n_docs), b.column(2).slice(at, w.n_docs), pa.array(np.diff(bounds)),
                     pa.array([x[f:t].astype(np.float32).tobytes() for f, t in zip(bounds[:-1], bounds[1:])], pa.binary())], ["doc_id", "y", "n", "x"])

    # passage features of at most max_train documents, about 100 bytes for 64 words
    rows = sample.select("text", "doc_id", "y").mapInArrow(run, "doc_id long, y int, n long, x binary").orderBy("doc_id").toPandas()
    if not len(rows):
        return Attention(np.zeros(FEATURES), np.ones(FEATURES))
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, FEATURES).astype(np.float64)
    bounds = np.concatenate(([0], np.cumsum(rows["n"].to_numpy(np.int64))))
    y = rows["y"].to_numpy(np.float64)
    net = Attention(x.mean(0), x.std(0) + 1e-3)
    share = (y.sum() + 1) / (len(y) + 2)
    net.p["d"][:] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        net.train(x, bounds, y, epochs)
    return net


def score(docs: DataFrame, net: Attention, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (),
          threshold: float = 0.3) -> DataFrame:
    """doc_id, the columns ``keep``, score, predicted, passages, and the first word of the weightiest passage."""
    no_clash(keep)
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    names = rows.columns[1:]

    def run(batches):
        net, pw = shared.value, Powers()
        for b in batches:
            for at, w in word_chunks(b.column(0), lower=False, pw=pw):
                x, bounds = passages(w)
                n = np.diff(bounds)
                y, (_, _, _, _, a, _) = net.forward(x.astype(np.float64), bounds[:-1], np.repeat(np.arange(w.n_docs), n))
                best = np.array([int(np.argmax(a[f:t])) for f, t in zip(bounds[:-1], bounds[1:])]) * PASSAGE
                yield pa.RecordBatch.from_arrays([*(c.slice(at, w.n_docs) for c in b.columns[1:]), pa.array(y), pa.array(n.astype(np.int32)),
                                                  pa.array(best.astype(np.int32))], [*names, "score", "passages", "key_word"])

    head = ddl_of(rows.schema.fields[1:])
    scored = rows.mapInArrow(run, f"{head}, score double, passages int, key_word int")
    return scored.withColumnsRenamed({f"kept_{c}": c for c in keep}).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
