"""Operators 6, 8, 9, the pipeline, and the registered queries against DuckDB."""

import glob
import re
import zlib

import numpy as np
import pytest
from fixtures import docs, empty, many, rows, texts, words

from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import mixing, packing, queries, url_rules

SF = "/root/testdata/sf0.001"


def path():
    return queries.tokenizer_path("word_bpe_49k.json")


def check_packing(pieces, data, size):
    """Every id in one piece, checksums right, sequences gapless and at most ``size`` long."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path())
    want = sorted(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in data)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    ids = {}
    for t in want:
        ids.setdefault(len(t), []).append(t)
    covered = sum(p.length for p in pieces)
    assert covered == sum(map(len, want))
    crcs = {zlib.crc32(np.array(t[s:s + n], "<u4").tobytes()) for t in want for s, n in
            {(p.start, p.length) for p in pieces if p.doc_tokens == len(t)}}
    assert all(p.ids_crc32 in crcs for p in pieces)
    seqs = {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for run in seqs.values():
        at = 0
        for p in sorted(run, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == run[0].sequence_length <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / covered


def test_packing(spark):
    pieces = packing.pack(docs(spark), path(), size=256).collect()
    assert check_packing(pieces, [r[:2] for r in rows()], 256) < 0.1
    assert check_packing(packing.pack(docs(spark), path(), size=256, by_word=False).collect(), [r[:2] for r in rows()], 256) < 0.1
    table = many(spark, 300, copies=100)
    data = [(r.doc_id, r.text) for r in table.collect()]
    assert check_packing(packing.pack(table, path(), size=128, group_docs=50).collect(), data, 128) < 0.05
    assert packing.pack(empty(spark), path()).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        lengths = np.sort(rng.integers(1, 100, n))[::-1]
        want, room = [], []
        for i, need in enumerate(lengths):
            b = next((b for b, free in enumerate(room) if free >= need), len(room))
            if b == len(room):
                room.append(100)
                want.append([])
            room[b] -= need
            want[b].append(i)
        assert packing.first_fit_decreasing(lengths, 100) == want


def brute_targets(sizes):
    total, left = sum(sizes.values()), set(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out = {}
    while True:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            left.discard(s)


def check_mix(got, data):
    size = {}
    for i, t, s in data:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(size)
    taken = {}
    for r in got:
        assert r.size >= 0 and r.source_size == size[r.source] and r.taken == r.repeats * r.size <= 3 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = max(len((t or "").split()) for _, t, _ in data)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)


def test_mixing(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(rows())
    check_mix(got, [(r[0], r[1], r[3]) for r in rows()])
    table = many(spark, 400, copies=150)
    data = [(r.doc_id, r.text, r.source) for r in table.collect()]
    first, again = (sorted(mixing.mix(t).collect()) for t in (table, table.repartition(7)))
    check_mix(first, data)
    assert first == again
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.repeats for r in first)
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(nothing).collect()] == [(0, 0.0)] * 2


def test_url_rules(spark):
    urls = ["https://www.example.com/en/a", "https://m.Example.com/en/a?x#y", "https://b.example.com/de/1", "http://a.example.net/fr/2",
            "http://a.example.net/en/2", "http://other.org/en/3#t", None, "no scheme", "ftp://net", "https://example.com?x", "://", "a://net/es/", "http://xnet/es/"]
    table = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_rules.judge(table, queries.SITE_RULES).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["www.example.com/en/", "example.com/en/", "com/", "net/fr/", None, None, None, None, None, None,
                                                       None, "net/es/", None]
    assert [(got[i].host, got[i].path) for i in (1, 6, 7, 8, 9)] == [("m.example.com", "/en/a"), ("", ""), ("", ""), ("net", ""), ("example.com", "")]
    assert [got[i].verdict for i in (0, 1, 2, 3)] == ["allow", "block", "allow", "block"] and all(r.verdict in ("allow", "block") for r in got.values())
    assert url_rules.judge(table.limit(0), queries.SITE_RULES).count() == 0
    assert {r.verdict for r in url_rules.judge(table, []).collect()} == {"allow"}


def test_long_urls_are_one_item(spark):
    """All subsets of a long URL's parts would be frequent in a small table."""
    long = "https://www.example.com/en/" + "/".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    urls = [long, "https://b.example.net/es/x", long.replace("www.example.com/en", "other.example.org/q"), "http://c.example.org/paa"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(table, queries.SITE_RULES).collect()}
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "allow", "allow"]
    assert got[2].mined and got[3].mined


def test_mined_rules_equal_brute_force(spark):
    """The deciding rule of every page, from all token sets counted one by one."""
    from itertools import combinations

    base = queries.table(spark, SF, "pages").select("page_id", "url")
    host, path_ = url_rules.host_of(base.url), url_rules.path_of(base.url)
    sets = {r.page_id: set(r.items) for r in base.select("page_id", url_rules.tokens(base.url, host, path_).alias("items")).collect()}
    got = {r.page_id: r for r in url_rules.judge(base, queries.SITE_RULES, min_support=0.05).collect()}
    labelled = {i: r.verdict for i, r in got.items() if r.rule}
    count, hit = {}, {}
    for i, v in labelled.items():
        for k in range(1, len(sets[i]) + 1):
            for c in combinations(sorted(sets[i]), k):
                count[c] = count.get(c, 0) + 1
                hit[c, v] = hit.get((c, v), 0) + 1
    least = int(np.ceil(0.05 * len(labelled) - 1e-9))
    rule = {(c, v): (n / count[c], n / len(labelled)) for (c, v), n in hit.items() if n >= least and n / count[c] >= 0.6}
    keep = {(c, v): x for (c, v), x in rule.items()
            if not any((tuple(y for y in c if y != z), v) in rule and rule[tuple(y for y in c if y != z), v][0] >= x[0] for z in c)}
    for i, r in got.items():
        if not r.rule:
            votes = [(conf, sup, len(c), " ".join(c), v) for (c, v), (conf, sup) in keep.items() if set(c) <= sets[i]]
            assert r.verdict == (max(votes)[-1] if votes else "allow")


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps columns and takes effect; the last packs exactly what is left."""
    from linkloom.llm import content_sort, minhash

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "mixing sources", "packing"]
    # identifiers beyond those of the labels, so that nothing is learned from chance
    table = docs(spark, [(90, texts()[0] + " tail", "en", "a", 1, "", 0, 0.0, "")]).withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("a.b", F.lit(1))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == table.columns
        if name == "toxicity":
            assert out.count() == table.count()  # nothing toxic here
        elif name == "exact dedup":
            assert out.count() == content_sort.content_sort(table).filter("kept").count() < table.count()
        elif name == "MinHash near-dedup":
            assert minhash.near_duplicates(out).filter("not kept").count() == 0 and out.count() < table.count()
        elif name == "mixing sources":
            want = {r.doc_id: r.repeats for r in mixing.mix(table).collect()}
            have = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert have == {i: n for i, n in want.items() if n}
        else:
            check_packing(out.collect(), [(r.doc_id, r.text) for r in table.collect()], 2048)
        table = out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    key = [c for c in ("doc_id", "vec_id") if c in cols][0]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_near_copies_go_row_by_row(spark):
    """Row 5 stands for a clean text and for a near copy of row 1; 7 is both rows of a group."""
    one, two = words(91, 60), words(92, 60)
    clean = words(93, 60)
    data = [(1, one), (5, one + " more"), (5, clean), (7, two), (7, two + " more"), (8, two + " again"), (9, None), (9, ""), (None, one + " yet")]
    table = spark.createDataFrame(data, "doc_id long, text string").withColumn("extra", F.lit(3))
    got = corpus_pipeline.drop_near_copies(spark, table, None)
    assert got.columns == table.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert [t for i, t in left if i == 5] == [clean]
    assert len([t for i, t in left if i == 7]) == 1 and not [t for i, t in left if i == 8]
    assert len(left) == 6 and sum(i == 9 for i, _ in left) == 2


def test_folds_are_crc32(spark):
    ids = [0, 1, 17, 123456789012, -5, None]
    got = {r.doc_id: r.m for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", queries.remainder().alias("m")).collect()}
    assert got == {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids}


def test_held_out_labels_change_no_score(spark, tmp_path):
    """Turning every held-out label round leaves all scores of the classifiers as they are."""
    for name in ("documents", "labels"):
        df = queries.table(spark, SF, name)
        if name == "labels":
            turned = [F.when(queries.remainder() == 0, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")]
            df = df.select("doc_id", *turned)
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (queries.op2_toxic_passages, queries.op4_attention_quality):
        a, b = ({r.doc_id: (r.score, r.predicted, r.held_out) for r in query(spark, d).collect()} for d in (SF, str(tmp_path)))
        assert a.keys() == b.keys() and all(abs(a[i][0] - b[i][0]) < 1e-9 and a[i][1:] == b[i][1:] for i in a)
        assert all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (_, _, held) in a.items())


def test_toxic_documents_leave_the_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    scored = {r.doc_id: r.predicted for r in queries.op2_toxic_passages(spark, sf).collect()}
    stays = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, queries.table(spark, sf, "documents"), sf).collect()}
    assert stays == {i for i, predicted in scored.items() if not predicted} and len(stays) < len(scored)
