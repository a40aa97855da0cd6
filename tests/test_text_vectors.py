import math

import numpy as np
from pyspark.sql import functions as F

from linkloom.operators import pillars as P
from linkloom.operators import similarity as S
from linkloom.operators import tfidf as TF

DOCS = ["Graph ranking with PageRank ranks pages", "Pages link to pages; ranking pages matters",
        "Café über résumé ranking", "Nothing shared here at all"]


def test_tfidf_matches_formula(spark):
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(DOCS)], "site string, url long, text string")
    w = TF.tfidf(df, stops=["with", "to", "at", "all", "here"], min_df=2, max_features=None).collect()
    terms = {r.term for r in w}
    assert terms == {"pages", "ranking"}
    n = len(DOCS)
    by_doc = {}
    for r in w:
        by_doc.setdefault(r.url, {})[r.term] = r
    for url, ts in by_doc.items():
        raw = {t: r.tf * (math.log((1 + n) / (1 + r.df)) + 1) for t, r in ts.items()}
        nrm = math.sqrt(sum(v * v for v in raw.values()))
        for t, r in ts.items():
            assert abs(r.w - raw[t] / nrm) < 1e-12


def test_bigrams_after_stop_words(spark):
    df = spark.createDataFrame([("s", 0, "the cat and the hat"), ("s", 1, "cat hat")], "site string, url long, text string")
    tf = {(r.url, r.term): r.tf for r in TF.term_counts(df).collect()}
    assert tf[(0, "cat hat")] == 1 and (0, "the cat") not in tf


def test_topk_similar_blocked_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(60, 8))
    rows = [("s", i, X[i].tolist()) for i in range(60)]
    vecs = spark.createDataFrame(rows, "site string, url long, vec array<double>")
    edges = spark.createDataFrame([("s", i, (i * 7) % 60) for i in range(60)], "site string, source long, target long")
    got = S.topk_similar(vecs, 3, min_sim=0.1, exclude_edges=edges, block_size=16).collect()
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    sims = U @ U.T
    want = set()
    for i in range(60):
        cands = [(-sims[i, j], j) for j in range(60) if j != i and j != (i * 7) % 60 and sims[i, j] >= 0.1]
        for _, j in sorted(cands)[:3]:
            want.add((i, j))
    assert {(r.source, r.target) for r in got} == want


def test_pillar_falls_back_to_all_members(spark):
    mem = spark.createDataFrame([("s", 1, 0, "t1", "short"), ("s", 2, 0, "t2", "also short")],
                                "site string, url long, cluster int, title string, text string")
    sim = spark.createDataFrame([("s", 1, 0.2), ("s", 2, 0.9)], "site string, url long, sim double")
    pr = spark.createDataFrame([("s", 1, 0.5), ("s", 2, 0.5)], "site string, url long, pagerank double")
    out = P.pillars(mem, sim, sim, pr).collect()
    assert len(out) == 1 and out[0].url == 2 and out[0].total_sim == 0.9


def test_randomized_svd_matches_numpy(spark, monkeypatch):
    """Three sites of different shapes in one job, the largest over several salts."""
    from linkloom.operators import svd

    monkeypatch.setattr(svd, "ENTRIES", 300)
    monkeypatch.setattr(svd, "BLOCK", 8)
    monkeypatch.setattr(svd, "FAN", 2)
    rng = np.random.default_rng(11)
    full, rows, voc = {}, [], []
    for site, n, t in (("big", 60, 25), ("mid", 30, 40), ("lone", 1, 6)):
        x = rng.random((n, 8)) @ rng.random((8, t))  # rank 8: the iteration is exact
        full[site] = x
        rows += [(site, f"{site}{i}", f"t{j:02d}", float(x[i, j])) for i in range(n) for j in range(t)]
        voc += [(site, f"t{j:02d}", j + 1) for j in range(t)]
    w = spark.createDataFrame(rows, "site string, url string, term string, w double").repartition(5)
    v = spark.createDataFrame(voc, "site string, term string, rank int")
    got = {(r.site, r.url): np.array(r.svd) for r in svd.randomized_svd(w, v, cap=5).collect()}
    assert len(got) == 91
    for site, x in full.items():
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        have = np.stack([got[site, f"{site}{i}"] for i in range(len(x))])
        want = (u * s)[:, :have.shape[1]]
        assert have.shape[1] == (1 if site == "lone" else 5)
        # equal up to the sign of each component
        for c in range(have.shape[1]):
            assert min(np.abs(have[:, c] - want[:, c]).max(), np.abs(have[:, c] + want[:, c]).max()) < 1e-6


def test_svd_jobs_do_not_grow_with_sites(spark):
    from linkloom.operators.svd import randomized_svd

    def jobs(sites):
        rng = np.random.default_rng(2)
        rows = [(f"s{s}", i, f"t{j}", float(rng.random())) for s in range(sites) for i in range(6) for j in range(5)]
        w = spark.createDataFrame(rows, "site string, url long, term string, w double")
        v = spark.createDataFrame([(f"s{s}", f"t{j}", j + 1) for s in range(sites) for j in range(5)], "site string, term string, rank int")
        group = f"svd-{sites}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            assert randomized_svd(w, v, cap=3, n_iter=2).count() == 6 * sites
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(1), jobs(12)
    assert 0 < many <= few + 5


def test_terms_are_not_shuffled_one_by_one(spark):
    """Counts are made where the document's text is, ranks of all terms in more than one task; weights equal those from given counts."""
    docs = spark.createDataFrame([("a" if i % 3 else "b", i % 40, f"w{i % 7} w{i % 5} same words w{i}") for i in range(60)] + [("a", None, "same w1"), (None, 1, "same"), ("b", 99, None)],
                                 "site string, url long, text string")
    tf = TF.term_counts(docs)
    plan = tf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "term" not in plan[plan.index("Exchange"):].split("\n")[0]
    voc = TF.vocabulary(tf).collect()
    for site in ("a", "b"):
        mine = sorted((r for r in voc if r.site == site), key=lambda r: (-r.cf, r.term))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
    key = lambda r: tuple((x is None, x) for x in r)
    one, two = (sorted(((r.site, r.url, r.term, r.tf, r.df, round(r.w, 12)) for r in w.collect()), key=key) for w in (TF.tfidf(docs), TF.tfidf(docs, tf=tf)))
    assert one == two and one
