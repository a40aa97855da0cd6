"""Operators 3, 5 and 10 against brute force."""

import hashlib
import random
import re

import numpy as np
from fixtures import docs, empty, many, rows

from linkloom.llm import caps, components, content_sort, hot, minhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def reachable(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(data):
    """component id by row, for rows with identifiers, linked by 75 % of shared shingles."""
    data = sorted((d for d in data if d[0] is not None), key=lambda d: d[0])
    sets = [shingles(t) for _, t in data]
    links = [(i, j) for i in range(len(data)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    roots = reachable(len(data), links)
    return {data[i][0]: (len(sets[i]), data[r][0]) for i, r in enumerate(roots)}


def test_content_sort_cases(spark):
    got = content_sort.content_sort(docs(spark)).collect()
    assert len(got) == len(rows())
    groups = {}
    for r in rows():
        groups.setdefault(lowered(r[1]), []).append(r[0])
    text = {(r[0], hashlib.sha256(lowered(r[1]).encode()).hexdigest()): lowered(r[1]) for r in rows()}
    for r in got:
        own = groups[text[(r.doc_id, r.text_sha256)]]
        known = [i for i in own if i is not None]
        assert r.group_size == len(own) and r.keep_id == (max(known) if known else None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert content_sort.content_sort(empty(spark)).count() == 0


def test_content_sort_hot_text_is_sliced(spark):
    table = many(spark, 60, copies=200)
    got = content_sort.content_sort(table, partitions=8).collect()
    hot = [r for r in got if r.group_size == 200]
    assert len(got) == 260 and len(hot) == 200 and {r.keep_id for r in hot} == {259} and sum(r.kept for r in hot) == 1
    carried = content_sort.content_sort(table, partitions=8, carry=True).filter("kept").select("row.*")
    assert carried.columns == table.columns and carried.count() == 61


def test_minhash_cases(spark):
    got = minhash.near_duplicates(docs(spark)).collect()
    want = brute_components([r[:2] for r in rows()])
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_families(spark, monkeypatch):
    """Edited copies at all rates, and a passage that unrelated documents share; with
    small blocks, so that large clusters are split."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    data = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 8)):
            w[k] = f"e{i}_{k}"
        data.append((i, " ".join(w[:rng.randint(100, 120)])))
    data += [(100 + i, " ".join(passage + [f"u{i}_{k}" for k in range(rng.randint(10, 80))])) for i in range(30)]
    table = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table).collect()}
    assert got == brute_components(data)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    want = reachable(400, links)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


def test_hot_join(spark, monkeypatch):
    """Hot, cold, null and unmatched keys give what a plain join gives."""
    monkeypatch.setattr(hot, "FLOOR", 3)
    keys = [1] * 50 + [2] * 2 + [3] * 9 + [None] * 20 + [7, 8]
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    side = spark.createDataFrame([(1, 50, "a"), (2, 2, "b"), (3, 9, "c"), (9, 1, "d")], "k long, n long, x string")
    for how in ("inner", "left"):
        for most in (100_000, 5):
            got = hot.hot_join(table, side, ["k"], len(keys), most, how)
            want = table.join(side.drop("n"), "k", how)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert hot.hot_join(table.limit(0), side.limit(0), ["k"], 0, how="left").columns == ["k", "i", "x"]


def test_components_of_hubs(spark, monkeypatch):
    """Stars whose centre is the largest, a middle and the smallest node, joined by a path."""
    monkeypatch.setattr(hot, "FLOOR", 5)
    links = [(100, i) for i in range(40)] + [(220, i) for i in range(200, 240)] + [(300, i) for i in range(301, 340)]
    links += [(39, 205), (900, 901)]
    want = reachable(1000, links)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: want[x] for x in {x for a, b in links if a != b for x in (a, b)}}


def test_set_identifiers():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [], [1, 2, 4], [1, 2, 3])]
    a, b = (x.to_pylist() for x in minhash.set_ids(sets))
    assert a[1] is None and b[1] is None and a[0] == a[3] and b[0] == b[3] and a[0] != a[2] and b[0] != b[2] and a[0] != b[0]
    assert [x.to_pylist() for x in minhash.set_ids([sets[1]])] == [[None], [None]]


def brute_vectors(data, cosine=0.93):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None and l is not None
          for i, v, l in data]
    links = []
    for i, (_, v, l) in enumerate(data):
        for j in range(i):
            w = data[j][1]
            if ok[i] and ok[j] and l == data[j][2] and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((j, i))
    return reachable(len(data), links), links


def test_spherical_caps(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 8)
    rng = np.random.default_rng(9)
    data, centres = [], rng.standard_normal((12, 16))
    for i in range(240):
        v = centres[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.08, 0.2])
        data.append((i, [float(np.float32(x)) for x in v], i % 3))
    data += [(240 + i, data[i][1], data[i][2]) for i in range(20)]
    data += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1),
             (305, data[0][1], None), (None, data[0][1], 0), (306, data[0][1][:5], 0), (307, data[0][1][:5], 0), (308, [1e-300] + [0.0] * 15, 2)]
    roots, links = brute_vectors(data)
    n = [0] * len(data)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_vectors(table).collect()}
    want = {d[0]: (n[i], data[roots[i]][0]) for i, d in enumerate(data)}
    assert got.keys() == want.keys()
    same = sum(got[k][:2] == want[k] for k in want)
    found, true = sum(x[0] for x in got.values()), sum(n)
    assert found <= true and found >= 0.97 * true and same >= 0.9 * len(want)
    assert got[300][0] == got[301][0] == got[305][0] == 0 and got[306][0] == 1 and got[None][:2] == (0, None)
    assert caps.near_vectors(table.limit(0)).count() == 0
