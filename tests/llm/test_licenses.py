"""Operator 13 against a scan of every place with regular expressions."""

import re

from fixtures import DOCS, docs, empty, rows, words

from linkloom.llm import licenses, queries

NOTICE = next(t for t in licenses.OTHERS if isinstance(t, licenses.Notice) and t.label == "mit")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    """(n_words, n_base, first, last, base labels, labels of phrases)."""
    w = re.findall(licenses.WORD, lower(text))
    starts, base, every = [], set(), set()
    for p in licenses.BASE + [t for t in licenses.OTHERS if isinstance(t, licenses.Phrase)]:
        want = p.text.split()
        for i in range(len(w) - len(want) + 1):
            if w[i:i + len(want)] == want:
                every.add(p.label)
                if p.base:
                    starts.append(i)
                    base.add(p.label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), every


def changed(text, every):
    out = text.split()
    for i in range(every, len(out), every):
        out[i] = "other"
    return " ".join(out)


def cases():
    filler = words(9, 60)
    return ["Released under the MIT License.", "under the MIT-license under\nthe_mit license", "cc-by-nc CC BY NC cc by  nc", "Apache License, Version 2.0",
            "apache license version 20", "é under the mit license", "éunder the mit license", "x under the mit licensé", filler + " under the mit license " + filler,
            "under the mit " * 500 + "license", ("cc by " * 300 + "nc ") * 3, "GNU General Public License, version 3.", "apache license version",
            f"{filler} {NOTICE.text.capitalize()}, and so on. {filler}", NOTICE.text, f"start {changed(NOTICE.text, 30)} end",
            NOTICE.text.replace("to deal in the software", "to trade in the software"), " ".join(reversed(NOTICE.text.split())),
            " ".join(NOTICE.text.split()[:12]), f"{NOTICE.text} {NOTICE.text}", "license " * 5000]


def test_scan(spark):
    extra = [(100 + i, t, "en", "a", 0, "", 0, 0.0, "") for i, t in enumerate(cases())]
    data = rows() + extra
    got = {(str(r.doc_id), r.n_words): r for r in licenses.scan(docs(spark, extra).repartition(3)).collect()}
    for r in data:
        n_words, n_base, first, last, base, every = brute(r[1])
        one = got[str(r[0]), n_words]
        assert (one.n_base, one.first_word, one.last_word, one.base_labels) == (n_base, first, last, base), r[1]
        found = set(filter(None, one.labels.split(",")))
        assert every <= found and found - every <= {"mit"}
        assert one.score == (1.0 if every else one.score) and 0 <= one.score <= 1
        assert (one.score > 0) == bool(found)
    notices = {t: got[str(100 + i), brute(t)[0]].notices for i, t in enumerate(cases())}
    assert notices[NOTICE.text] == "mit@0" and notices[cases()[13]] == f"mit@{len(re.findall(licenses.WORD, lower(words(9, 60))))}"
    assert notices[cases()[15]].startswith("mit@")  # words changed in between
    for i in (16, 17, 18, 20):  # a mandatory phrase is missing, or the words stand elsewhere
        assert notices[cases()[i]] == "", cases()[i][:40]
    assert notices[cases()[19]] == "mit@0"
    assert licenses.scan(empty(spark)).collect() == []


def test_index_posts_rare_words(spark):
    """Words of many documents aren't a notice's index words, and counts cover every document."""
    data = [(i, "this software is the use " + words(i, 5), "en", "a", 0, "", 0, 0.0, "") for i in range(200)]
    table = spark.createDataFrame(data, DOCS)
    n, held = licenses.document_counts(table, ["software", "the", "sublicense"])
    assert (n, held) == (200, {"software": 200, "the": 200, "sublicense": 0})
    index = licenses.Index([NOTICE], n, held)
    hashed = {x[0] for x in index.notices[0][0]}
    assert int(licenses.hashes_of("sublicense")[0]) in {int(licenses.hashes_of(w)[0]) for w in NOTICE.text.split()}
    assert not hashed & {int(licenses.hashes_of(w)[0]) for w in ("software", "the")}


def test_registered_query(spark):
    rows_of = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_license_index(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows_of)
    for r in rows_of:
        n_words, n_base, first, last, base, every = brute(r.text)
        one = got[r.doc_id]
        assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (n_words, n_base, first, last, base)
        assert every <= set(filter(None, one.labels.split(",")))
