"""Operator 11 against whole texts encoded at once and counts kept in dictionaries."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from fixtures import DOCS, docs, empty, many, rows

from linkloom.llm import alignment, queries

ODD = ["a  b", " lead", "tail ", "\n\n  x\t y", "it's  we'll   don't", "x　 y", "日本 語 のテキスト", "“quoted” text — dash", "<|endoftext|> <s> </s> <0x41>",
       "a▁b", "word" * 3000, "🙂 🙂🙂", "\x00 \x1f  z", "ﬁ ﬀ ² ½", "é é", "\r\n \r\n", "1 22  333", "    ", "𝒳 ð", "a   b", "\u0085 x \u0085  y"]


def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def brute(texts):
    """(n_a, n_b, n_groups, n_links, sha, n_best, count_sum) of each text; and the links by pair, the documents by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths()[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    chars = alignment.byte_of_char()
    assert sorted(chars.values()) == list(range(256))
    out, links, held = [], Counter(), Counter()
    for t in texts:
        enc = a.encode(" " + t, add_special_tokens=False) if t else None
        x = [bytes(chars[c] for c in token) for token in enc.tokens] if t else []
        ids_b = b.encode(t) if t else []
        y = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            out.append(([], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, x))).tolist(), np.cumsum(list(map(len, y))).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        groups, pairs, i, j = [], [], 0, 0
        for e in both:
            u, v = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, enc.ids[i:u])) + "|" + ",".join(map(str, ids_b[j:v])))
            pairs.append((enc.ids[u - 1], ids_b[v - 1]))
            i, j = u, v
        links.update(pairs)
        held.update(set(pairs))
        out.append((enc.ids, ids_b, pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, v), n in links.items():
        top[v] = max(top[v], n)
    done = [(len(p), len(q), len(s), len(s), sha, sum(links[x] == top[x[1]] for x in s), sum(links[x] for x in s)) for p, q, s, sha in out]
    return done, links, held


def result(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect())


def test_alignment(spark):
    extra = [(100 + i, t, "en", "a", 0, "", 0, 0.0, "") for i, t in enumerate(ODD)]
    data = rows() + extra
    want, _, _ = brute([r[1] for r in data])
    got = result(alignment.align(docs(spark, extra).repartition(3), *paths()))
    assert got == sorted((str(r[0]), *w) for r, w in zip(data, want))
    assert alignment.align(empty(spark), *paths()).collect() == []


def test_whole_texts_as_units(spark, monkeypatch):
    """Without the units' rule a text is one unit: same groups."""
    table = docs(spark)
    tokens = alignment.Aligner(*paths())
    assert not tokens.whole
    column = pa.array([r[1] for r in rows()] + ODD)
    by_unit = tokens.documents(alignment.Units(column, 0, len(column), alignment.Powers(), False))
    tokens.clear()
    whole = tokens.documents(alignment.Units(column, 0, len(column), alignment.Powers(), True))
    for x, y in zip(by_unit, whole):
        assert list(x) == list(y)
    assert table.count() == len(rows())


def test_blocks_and_planes(spark, monkeypatch):
    """Pairs that are frequent in a block (plain bits), frequent in a text (several planes), over many blocks."""
    data = [(i, ("the " * (1 + i % 9) + "end").strip(), "en", "a", 0, "", 0, 0.0, "") for i in range(5000)]
    table = spark.createDataFrame(data, DOCS).coalesce(1)
    want, links, held = brute([r[1] for r in data])
    assert result(alignment.align(table, *paths())) == sorted((str(r[0]), *w) for r, w in zip(data, want))
    table = many(spark, 400, copies=60)
    data = [(r.doc_id, r.text) for r in table.collect()]
    want, links, held = brute([t for _, t in data])
    assert result(alignment.align(table, *paths())) == sorted((str(i), *w) for (i, _), w in zip(data, want))
    indexed = alignment.index(table, *paths())
    got = {(r.a, r.b): (r.docs, r.links) for r in alignment.pair_scores(indexed).collect()}
    assert got == {p: (held[p], links[p]) for p in links}


def test_bitmaps():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([np.uint64(7 << alignment.LOW) | np.arange(0, 32768, 2, dtype=np.uint64),
                                     (rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(alignment.LOW)) | rng.integers(0, 1 << 15, 4000).astype(np.uint64)]))
    times = rng.integers(1, 300, len(keys))
    pair, n, links, planes = alignment.bitmaps(keys, times)
    row, doc, worth = alignment.read_bitmaps(planes)
    back = Counter()
    for r, d, w in zip(row.tolist(), doc.tolist(), worth.tolist()):
        back[pair[r] << alignment.LOW | d] += w
    assert back == dict(zip(keys.tolist(), times.tolist()))
    assert n.sum() == len(keys) and links.sum() == times.sum()
    none = alignment.bitmaps(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert len(none[0]) == 0 and len(alignment.read_bitmaps(none[3])[0]) == 0
