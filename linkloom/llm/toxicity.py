"""Operator 2, toxicity by maximum-scoring segments.

Lexicon: for every word and for its first four and five bytes, the log-odds of
toxic against clean labelled documents under an informative Dirichlet prior
(prior counts in proportion to the pooled counts); a feature is used when its
z-score and effect are large enough.  A word that repeats in the same context
(the words before and after) counts once, so copies of a passage don't make
lexicon entries.  A token scores as its most significant feature, less a small
drift, so that clean text drifts down.

Passages: one linear scan (the all-maximal-scoring-subsequences algorithm) finds
every passage whose score no shorter or longer one beats.  In clean text of n
words the best passage score follows an extreme-value law with location
ln(K n) and scale 1 (scores are natural log-odds); K is fitted on labelled clean
documents, and a document's evidence is the sum of what its passages score above
that location.  A logistic curve on the evidence, fitted on labelled documents
that the lexicon has not seen, gives the score.

Fitting reads a sample of at most ``max_train`` labelled documents, chosen by
hash, which also bounds the lexicon: every feature of it that stands in enough
contexts takes part.  Scoring reads all documents.

Defined cases: null text is empty; an empty text has no passage and gets the
score of no evidence; labels that are null are ignored, a document labelled more
than once counts as its highest label; without toxic labels the lexicon is empty
and every score is the same; rows with equal identifiers are scored one by one;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import Powers, ddl_of, mix, no_clash, small_batches, sums_by_key, word_chunks
from linkloom.operators.iterate import cut

PREFIX_BYTES = (4, 5)
DRIFT = 0.05
SURE = 12.0
SPANS = "array<struct<first_word:int,words:int,score:float>>"


def features(words, pw: Powers) -> list[np.ndarray]:
    """Hashes of each word's features: its leading bytes, then the word."""
    out = []
    up, down = pw.upto(len(words.data) + 1)
    lead = np.zeros(len(words.begin), np.uint64)
    for k in range(max(PREFIX_BYTES)):
        at = np.minimum(words.begin + k, len(words.data) - 1)
        here = np.where(words.begin + k < words.end, words.data[at], 0).astype(np.uint64)
        lead = (lead << np.uint64(8)) | here
        if k + 1 in PREFIX_BYTES:
            out.append(mix(lead + np.uint64(k + 1 << 56)))
    return [*out, words.h]


def contexts(words) -> np.ndarray:
    h, inside = words.h, words.doc[1:] == words.doc[:-1]  # neighbours of one text
    before, after = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    before[1:], after[:-1] = np.where(inside, h[:-1], 0), np.where(inside, h[1:], 0)
    return mix(h + mix(before + np.uint64(1)) * np.uint64(3) + mix(after + np.uint64(2)) * np.uint64(5))


class Lexicon:
    """Feature hashes (sorted) and their scores; ``rank`` orders features of one word."""

    def __init__(self, h, score, z):
        order = np.argsort(h)
        self.h, self.score, self.z = h[order], score[order], z[order]
        self.seen = np.zeros(1 << 22, bool)  # by leading bits: most words end here
        self.seen[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def scores(self, words, pw: Powers) -> np.ndarray:
        best = np.zeros(len(words.h))
        out = np.zeros(len(words.h))
        if len(self.h):
            for h in features(words, pw):
                may = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.h, h[may]), len(self.h) - 1)
                hit = self.h[at] == h[may]
                may, at = may[hit], at[hit]
                better = np.abs(self.z[at]) > best[may]
                may, at = may[better], at[better]
                best[may], out[may] = np.abs(self.z[at]), self.score[at]
        out[1:][(words.h[1:] == words.h[:-1]) & (words.doc[1:] == words.doc[:-1])] = 0  # a word said again and again is one piece of evidence
        return out - DRIFT


def passages(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), left to right, in linear time."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.diff(np.concatenate(([0], up.astype(np.int8), [0])))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[tuple] = []  # left sum, right sum, first, end, stack index of the nearest lower left sum
    for a, b in zip(first.tolist(), end.tolist()):
        left, right = total[a], total[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, a, b, j))
                break
            left, a = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(r - l)) for l, r, a, b, _ in stack]


def found_in(batch_text, lexicon: Lexicon, pw: Powers):
    """Yield (row, words in the text, its passages)."""
    for at, words in word_chunks(batch_text, pw=pw):
        scores = lexicon.scores(words, pw)
        hit = np.zeros(words.n_docs, bool)
        hit[words.doc[scores > 0]] = True
        for d in range(words.n_docs):
            f, n = words.first[d], words.count[d]
            yield at + d, int(n), passages(scores[f:f + n]) if hit[d] else []


def evidence(n: int, segs: list, log_k: float) -> float:
    """Sum of what passages score above the extreme-value location; without any
    such passage, how far the best one stays below it.  Beyond ``SURE`` (a chance
    of e**-SURE in clean text) more evidence says no more, so that mislabelled
    documents don't flatten the curve."""
    where = log_k + np.log(max(n, 1))
    over = [s - where for _, _, s in segs if s > where]
    x = sum(over) if over else max((s for _, _, s in segs), default=0.0) - where
    return float(np.clip(x, -SURE, SURE))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset, with smoothed targets so that separable data stay finite."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    mean, sd = x.mean(), x.std() or 1.0
    u = (x - mean) / sd
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g = np.array([((p - t) * u).sum() + 1e-3 * a, (p - t).sum()])
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * u * u).sum() + 1e-3, (w * u).sum()], [(w * u).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(hess + 1e-9 * np.eye(2), g), -2, 2)
        a, b = a - step[0], b - step[1]
    return float(a / sd), float(b - a * mean / sd)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_train: int = 20_000, min_contexts: int = 5, min_z: float = 3.0,
        min_effect: float = 1.0) -> dict:
    """Model as a small dict: lexicon arrays, K of the extreme-value law, logistic curve."""
    small_batches(docs)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    part = min(1.0, max_train / max(1, known.count()))
    mark = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20))
    known = known.filter(mark < int(part * (1 << 20))).withColumn("calibrate", F.pmod(mark, F.lit(4)) == 0)
    # the sample's bound is the broadcast's bound: max_train rows, with some room for chance
    sample = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id"))

    def toxic_words(batches):
        pw = Powers()
        for b in batches:
            for _, w in word_chunks(b.column(0), pw=pw):
                ctx, at = np.unique(contexts(w), return_index=True)
                cols = [ctx, *(f[at] for f in features(w, pw))]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["ctx", "f0", "f1", "f2"])

    lex = sample.filter("not calibrate")
    seen = lex.filter("y = 1").select("text").mapInArrow(toxic_words, "ctx long, f0 long, f1 long, f2 long").dropDuplicates(["ctx"])
    seen = cut(seen)
    n_toxic = seen.count()
    counts = (seen.select(F.explode(F.array("f0", "f1", "f2")).alias("f")).groupBy("f").count()
              .filter(F.col("count") >= min_contexts).toPandas())
    h = counts["f"].to_numpy(np.int64).view(np.uint64)
    toxic = counts["count"].to_numpy(np.float64)
    order = np.argsort(h)
    h, toxic = h[order], toxic[order]
    feats = docs.sparkSession.sparkContext.broadcast(h)

    def clean_words(batches):
        pw, table = Powers(), feats.value
        hits, n = np.zeros(len(table), np.int64), 0
        for b in batches:
            for _, w in word_chunks(b.column(0), pw=pw):
                n += len(w.h)
                for f in features(w, pw):
                    if len(table):
                        f, c = sums_by_key(f)
                        at = np.minimum(np.searchsorted(table, f), len(table) - 1)
                        ok = table[at] == f
                        hits[at[ok]] += c[ok]
        at = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(hits[at], n))], ["i", "n"])

    clean_rows = lex.filter("y = 0").select("text").mapInArrow(clean_words, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    clean = np.zeros(len(h))
    found = clean_rows[clean_rows["i"] >= 0]
    clean[found["i"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    n_clean = float(clean_rows.loc[clean_rows["i"] < 0, "n"].sum())

    prior = 0.01 * (toxic + clean)  # prior counts: a hundredth of the pooled ones
    all_prior = 0.01 * (n_toxic + n_clean)
    effect = np.log((toxic + prior) / (n_toxic + all_prior)) - np.log((clean + prior) / (n_clean + all_prior) + 1e-300)
    z = effect / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    use = (np.abs(z) >= min_z) & (np.abs(effect) >= min_effect) if n_clean and n_toxic else np.zeros(len(h), bool)
    model = {"h": h[use], "score": effect[use], "z": z[use], "log_k": 0.0, "slope": 0.0, "offset": -2.0}

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        pw, lexicon = Powers(), None
        for b in batches:
            m = shared.value
            lexicon = lexicon or Lexicon(m["h"], m["score"], m["z"])
            rows = [(n, [s for _, _, s in segs]) for _, n, segs in found_in(b.column(0), lexicon, pw)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.list_(pa.float64())), b.column(1)], ["n", "segs", "y"])

    held = sample.filter("calibrate").select("text", "y").mapInArrow(measured, "n long, segs array<double>, y int").toPandas()
    best = np.array([max(s, default=0.0) for s in held["segs"].map(list)])
    n, y = np.maximum(held["n"].to_numpy(np.float64), 1), held["y"].to_numpy(np.float64)
    if (y == 0).any():
        model["log_k"] = float(-np.log(np.mean(np.exp(-(best - np.log(n))[y == 0]))))
    if use.any() and (y == 0).any() and (y == 1).any():
        x = np.array([evidence(k, [(0, 0, v) for v in s], model["log_k"]) for k, s in zip(held["n"], held["segs"])])
        model["slope"], model["offset"] = fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """doc_id, the columns ``keep``, score, predicted, and the significant passages
    (first word, number of words, score above the extreme-value location)."""
    no_clash(keep)
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"kept_{c}") for c in keep])

    names = rows.columns[1:]

    def scored(batches):
        pw, lexicon = Powers(), None
        for b in batches:
            m = shared.value
            lexicon = lexicon or Lexicon(m["h"], m["score"], m["z"])
            out, spans = [], []
            for _, n, segs in found_in(b.column(0), lexicon, pw):
                x = evidence(n, segs, m["log_k"])
                out.append(1 / (1 + np.exp(-np.clip(m["slope"] * x + m["offset"], -700, 700))))
                where = m["log_k"] + np.log(max(n, 1))
                spans.append([{"first_word": a, "words": e - a, "score": s - where} for a, e, s in segs if s > where])
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("score", pa.float32())]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(out, pa.float64()), pa.array(spans, kind)],
                                             [*names, "score", "spans"])

    head = ddl_of(rows.schema.fields[1:])
    scored_rows = rows.mapInArrow(scored, f"{head}, score double, spans {SPANS}")
    return scored_rows.withColumnsRenamed({f"kept_{c}": c for c in keep}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
