"""Operator 13, license scans with a positional index of rare words.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased.
Two kinds of templates are indexed: phrases, whose words must stand consecutively, and
notices, which name their mandatory phrases and may have words changed in between.

How many of all documents hold each template word is counted first; that gives the words'
IDF.  The index posts (template, position) under a phrase's rarest word, and under a
notice's ``RARE`` rarest ones.  A document's words are looked up in it: each place of an
indexed word names, by relative position, where its template would begin.  A phrase is
there if all its words stand at that beginning.  For a notice, the words that agree on a
beginning within ``SLACK`` words add up their IDF; where they reach ``least`` of the
notice's and all its mandatory phrases stand within its span, its label is given.  Every
occurrence is looked up, whatever their number.

Words are compared by 64-bit hashes within and across texts; the index holds a few hundred.
A document's score is the largest share of IDF that any found phrase (1) or notice has, 0 without any.

Defined cases: null text is empty; an empty text has no words, no labels and score 0; texts
are read whole; null or repeated identifiers are scored row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import Powers, bytes_of, lowered, mix, small_batches

CHUNK = 1 << 20
RARE, SLACK = 8, 8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCANNED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, notices string")


@dataclass(frozen=True)
class Phrase:
    text: str
    label: str
    base: bool = False  # counted in n_base


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    mandatory: tuple  # phrases that must stand within it


# Fixed values of the contract.
BASE = [
    Phrase("under the mit license", "mit", True),
    Phrase("apache license version 2", "apache-2", True),
    Phrase("cc by nc", "cc-by-nc", True),
]

# Public wordings of license lines and notices.
OTHERS = [
    Phrase("gnu general public license version 3", "gpl-3"),
    Phrase("gnu general public license version 2", "gpl-2"),
    Phrase("gnu lesser general public license", "lgpl"),
    Phrase("gnu affero general public license", "agpl"),
    Phrase("mozilla public license version 2 0", "mpl-2"),
    Phrase("eclipse public license", "epl"),
    Phrase("bsd 3 clause license", "bsd-3-clause"),
    Phrase("bsd 2 clause license", "bsd-2-clause"),
    Phrase("creative commons attribution sharealike", "cc-by-sa"),
    Phrase("creative commons attribution noncommercial", "cc-by-nc"),
    Phrase("spdx license identifier mit", "mit"),
    Phrase("spdx license identifier apache 2 0", "apache-2"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
           "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute "
           "sublicense and or sell copies of the software", "mit", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Notice("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
           "license 2 0", "apache-2", ("except in compliance with the license", "apache org licenses")),
    Notice("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
           "are met redistributions of source code must retain the above copyright notice", "bsd", ("redistribution and use in source and binary forms",)),
    Notice("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
           "above copyright notice and this permission notice appear in all copies", "isc", ("for any purpose with or without fee is hereby granted",)),
    Notice("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
           "distribute this software", "unlicense", ("free and unencumbered software released into the public domain",)),
]


def word_hashes(column, at: int, to: int, pw: Powers):
    """(hashes, first word of each text and the end of the last) of the words of rows at .. to."""
    data, bounds = bytes_of(column.slice(at, to - at))
    data, bounds = lowered(data[bounds[0]:bounds[-1]]), bounds - bounds[0]
    n = len(data)
    inside = (data >= 0x80) | ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10)
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begin = np.flatnonzero(inside & (cut[:n] | ~before))
    end = np.flatnonzero(inside & (cut[1:] | ~after)) + 1
    up, down = pw.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(begin, bounds)


def chunks(column, pw: Powers):
    """(first row, row after the last, hashes, first words) for runs of rows of about a megabyte."""
    bounds, at = bytes_of(column)[1], 0
    while at < len(column):
        to = min(len(column), max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1))
        yield at, to, *word_hashes(column, at, to, pw)
        at = to
    pa.default_memory_pool().release_unused()


def hashes_of(text: str) -> np.ndarray:
    return word_hashes(pa.array([text]), 0, 1, Powers())[0]


def words_in(text: str) -> list:
    return re.findall(WORD, text)


class Lookup:
    """Numbers of known hashes: a table by 16 bits lets most words pass at once."""

    def __init__(self, h: np.ndarray):
        self.h = np.unique(h)
        self.may = np.zeros(1 << 16, bool)
        self.may[(self.h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray):
        """(positions of known hashes, their numbers)."""
        at = np.flatnonzero(self.may[(h & np.uint64(0xFFFF)).astype(np.int64)])
        no = np.minimum(np.searchsorted(self.h, h[at]), max(len(self.h) - 1, 0))
        same = self.h[no] == h[at] if len(self.h) else np.zeros(0, bool)
        return at[same], no[same]


def document_counts(docs: DataFrame, words: list, text_col: str = "text") -> tuple[int, dict]:
    """Number of documents, and in how many of them each of ``words`` stands."""
    known = {int(hashes_of(w)[0]): w for w in words}
    h = np.array(sorted(known), np.uint64)

    def run(batches):
        look, pw, held, n = Lookup(h), Powers(), np.zeros(len(h), np.int64), 0
        for b in batches:
            for at, to, hashes, first in chunks(b.column(0), pw):
                place, no = look.places(hashes)
                doc = np.searchsorted(first, place, "right") - 1
                held += np.bincount(np.unique(doc * len(h) + no) % max(len(h), 1), minlength=len(h))
                n += to - at
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(h)), -1], pa.int32()), pa.array([*held.tolist(), n], pa.int64())], ["no", "n"])

    texts = small_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(run, "no int, n long").groupBy("no").agg(F.sum("n").alias("n")).collect()  # a row per template word
    count = {r["no"]: r["n"] for r in rows}
    return count.pop(-1, 0), {known[int(h[i])]: n for i, n in count.items()}


class Index:
    """Postings of the templates' rare words, and the templates as hashes."""

    def __init__(self, templates: list, n_docs: int, held: dict):
        idf = {w: float(np.log((n_docs + 1) / (held.get(w, 0) + 0.5))) for t in templates for w in words_in(t.text)}
        self.phrases, self.notices = [], []
        by_text: dict = {}
        for t in templates:
            wanted = [t] if isinstance(t, Phrase) else [Phrase(m, "") for m in t.mandatory]
            for p in wanted:
                if p.text in by_text and not p.label:
                    continue
                by_text[p.text] = len(self.phrases)
                w = words_in(p.text)
                anchor = max(range(len(w)), key=lambda i: (idf.get(w[i], 0.0), -i))
                self.phrases.append((hashes_of(p.text), anchor, p))
        for t in templates:
            if isinstance(t, Notice):
                w = words_in(t.text)
                rare = sorted(set(w), key=lambda x: (-idf[x], x))[:RARE]
                posts = [(int(hashes_of(x)[0]), i, max(idf[x], 0.0)) for i, x in enumerate(w) if x in rare]
                total = sum(x[2] for x in posts)
                if total:
                    self.notices.append((posts, total, len(w), [by_text[m] for m in t.mandatory], t.label))
        self.look = Lookup(np.array([int(h[a]) for h, a, _ in self.phrases] + [x[0] for n in self.notices for x in n[0]], np.uint64))

    def phrase_places(self, h, first, place, no):
        """For each phrase the words where it begins."""
        out = []
        for words, anchor, _ in self.phrases:
            at = place[self.look.h[no] == words[anchor]] - anchor
            at = at[(at >= 0) & (at + len(words) <= len(h))]
            for j, w in enumerate(words):
                at = at[h[at + j] == w]
            doc = np.searchsorted(first, at, "right")
            out.append(at[at + len(words) <= first[np.minimum(doc, len(first) - 1)]])
        return out

    def notice_places(self, first, place, no, phrases, least: float):
        """(notice, text, place, share) of the notices that stand in the texts."""
        for number, (posts, total, length, mandatory, _) in enumerate(self.notices):
            doc, begin, word, worth = [], [], [], []
            for k, (h, i, idf) in enumerate(posts):
                at = place[self.look.h[no] == np.uint64(h)]
                doc.append(np.searchsorted(first, at, "right") - 1)
                begin.append(at - i)
                word.append(np.full(len(at), k))
                worth.append(np.full(len(at), idf))
            doc, begin, word, worth = (np.concatenate(x) for x in (doc, begin, word, worth))
            order = np.lexsort((word, begin, doc))
            doc, begin, word, worth = doc[order], begin[order], word[order], worth[order]
            # words that name a beginning within SLACK after this one, in the same text
            key = doc * (1 << 40) + begin + (1 << 30)
            to = np.searchsorted(key, key + SLACK, "right")
            sums = np.concatenate(([0.0], np.cumsum(worth)))
            for i in np.flatnonzero(sums[to] - sums[:-1] >= least * total - 1e-9).tolist():
                seen = np.unique(word[i:to[i]])
                share = sum(posts[k][2] for k in seen.tolist()) / total
                if share < least - 1e-9:
                    continue
                lo, hi = begin[i] - SLACK, begin[i] + length + 2 * SLACK
                lo, hi = max(lo, first[doc[i]]), min(hi, first[doc[i] + 1])
                if all(((p := phrases[m]) >= lo).any() and ((p >= lo) & (p + len(self.phrases[m][0]) <= hi)).any() for m in mandatory):
                    yield number, int(doc[i]), int(begin[i]), min(1.0, share)


def scan(docs: DataFrame, templates: list | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    notices (label@word of each notice's best place)."""
    templates = BASE + OTHERS if templates is None else templates
    words = sorted({w for t in templates for x in (t.text, *getattr(t, "mandatory", ())) for w in words_in(x)})
    n_docs, held = document_counts(docs, words, text_col)
    names = [x.strip().split()[0] for x in SCANNED.split(", ")]

    def run(batches):
        index, pw = Index(templates, n_docs, held), Powers()
        for b in batches:
            for at, to, h, first in chunks(b.column(1), pw):
                n = to - at
                place, no = index.look.places(h)
                found = index.phrase_places(h, first, place, no)
                n_base, low, high = np.zeros(n, np.int64), np.full(n, len(h) + 1), np.full(n, -1)
                score, base, labels, notices = np.zeros(n), {}, {}, {}
                for (_, _, p), starts in zip(index.phrases, found):
                    if not p.label:
                        continue
                    doc = np.searchsorted(first, starts, "right") - 1
                    score[doc] = 1.0
                    for d in np.unique(doc).tolist():
                        labels.setdefault(d, set()).add(p.label)
                        if p.base:
                            base.setdefault(d, set()).add(p.label)
                    if p.base:
                        np.add.at(n_base, doc, 1)
                        np.minimum.at(low, doc, starts - first[doc])
                        np.maximum.at(high, doc, starts - first[doc])
                for number, d, begin, share in index.notice_places(first, place, no, found, least):
                    label = index.notices[number][-1]
                    labels.setdefault(d, set()).add(label)
                    score[d] = max(score[d], share)
                    best = notices.setdefault(d, {}).get(label, (0.0, 0))
                    notices[d][label] = max(best, (share, -(begin - int(first[d]))))
                none = n_base == 0
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, n), pa.array(np.diff(first)), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(base.get(d, ()))) for d in range(n)], pa.string()),
                    pa.array([",".join(sorted(labels.get(d, ()))) for d in range(n)], pa.string()), pa.array(score),
                    pa.array([",".join(f"{k}@{max(0, -v[1])}" for k, v in sorted(notices.get(d, {}).items())) for d in range(n)], pa.string())], names)

    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, SCANNED)
