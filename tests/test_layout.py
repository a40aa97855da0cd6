"""The neighbour-preserving layout against plain matrices, and against the linear plane."""
import numpy as np

from linkloom.operators import clustering as K
from linkloom.operators import layout as L


def _plain(x, k, rounds, start):
    n = len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    near = np.argsort(-c, axis=1, kind="stable")[:, :min(k, n - 1)]
    a = np.eye(n)
    for i, row in enumerate(near):
        a[i, row] = a[row, i] = 1
    d = a.sum(1)
    s, q = a / np.sqrt(np.outer(d, d)), np.sqrt(d) / np.sqrt(d.sum())

    def orth(z):
        z, r = np.linalg.qr(z - np.outer(q, q @ z))
        return z * np.sign(np.diag(r))

    z = start
    for _ in range(rounds):
        z = s @ orth(z)
    return orth(z) / np.sqrt(d)[:, None] * np.sqrt(d.sum()), near


def _kept(plane, near):
    d = ((plane[:, None] - plane[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    mine = np.argsort(d, axis=1)[:, :near.shape[1]]
    return np.mean([len(set(a) & set(b)) for a, b in zip(mine, near)]) / near.shape[1]


def test_layout_equals_plain_matrices_and_keeps_more_neighbours(spark):
    rng = np.random.default_rng(9)
    t = rng.random(120) * 3 * np.pi
    curl = np.column_stack([t * np.cos(t), t * np.sin(t), 4 * rng.random(120), np.sin(2 * t) * 3, np.cos(3 * t) * 3, 3 * rng.standard_normal(120)])
    sites = {"curl": curl, "noise": rng.standard_normal((40, 6))}
    rows = [(s, f"{s}{i:03d}", v.tolist()) for s, x in sites.items() for i, v in enumerate(x)] + [("one", "one0", [1.0] * 6)]
    vecs = spark.createDataFrame(rows, "site string, url string, vec array<double>").repartition(4)
    linear = {r.url: (r.x, r.y) for r in K.layout_2d(vecs).collect()}
    got = {r.url: (r.x, r.y) for r in L.neighbour_layout(vecs, k=8, rounds=6).collect()}
    assert len(got) == 161 and got["one0"] == (0.0, 0.0)
    for s, x in sites.items():
        start = np.array([linear[f"{s}{i:03d}"] for i in range(len(x))])
        have = np.array([got[f"{s}{i:03d}"] for i in range(len(x))])
        want, near = _plain(x, 8, 6, start)
        assert np.allclose(have, want, atol=1e-6)
        if s == "curl":
            assert _kept(have, near) > _kept(start, near)


def test_equal_vectors_and_no_rows(spark):
    same = spark.createDataFrame([("s", i, [1.0, 2.0]) for i in range(4)], "site string, url long, vec array<double>")
    out = L.neighbour_layout(same, k=2, rounds=2).collect()
    assert len(out) == 4 and all(np.isfinite([r.x, r.y]).all() for r in out)
    assert L.neighbour_layout(same.limit(0), k=2, rounds=1).count() == 0
