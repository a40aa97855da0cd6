"""Operator 12 against plain loops over Python integers."""

import hashlib
import math
import random

import duckdb

from linkloom.llm import queries, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, part long, code string"
SF = "/root/testdata/sf0.001"


def brute(data, positions=8, entries=16, rounds=6):
    kept = sorted((r for r in data if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])),
                  key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * x) for x in r[1]]))
    if not kept:
        return []
    width = len(kept[0][1]) // positions
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    q = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    parts = [[v[p * width:(p + 1) * width] for p in range(positions)] for v in q]
    book = [[list(parts[e][p]) for e in range(min(entries, len(parts)))] for p in range(positions)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        owner = [[near(v[p], p)[1] for p in range(positions)] for v in parts]
        for p in range(positions):
            for e in range(len(book[p])):
                mine = [v[p] for v, o in zip(parts, owner) if o[p] == e]
                if mine:
                    book[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(kept, parts):
        best = [near(v[p], p) for p in range(positions)]
        error = sum(d for d, _ in best)
        out.append([r[0], "".join(f"{e:02x}" for _, e in best), error, r[2], sha])
        by_label[r[2]] = by_label.get(r[2], 0) + error
    return sorted(((i, c, e, by_label[lab], s) for i, c, e, lab, s in out), key=str)


def result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], VECTORS)


def test_resident_lloyd(spark, monkeypatch):
    rng = random.Random(3)
    data = [(i * 7 % 301, [round(rng.gauss(i % 5, 0.4) * 8) / 8 for _ in range(16)], [0, 1, None][i % 3]) for i in range(300)]
    data += [(400, None, 1), (401, [float("nan")] * 16, 1), (402, [None] + [1.0] * 15, 1), (403, [float("inf")] * 16, 0), (404, [1.0] * 8, 0), (405, [], 0),
             (None, [0.5] * 16, 0), data[3], data[3], (-5, [-0.0001] * 16, None), (406, [900.0] + [0.0] * 15, 2)]
    want = brute(data)
    assert result(vector_codes.compress(table(spark, data).repartition(3))) == want
    monkeypatch.setattr(vector_codes, "SALT_ROWS", 40)  # an entry over several salts
    assert result(vector_codes.compress(table(spark, data).repartition(3))) == want


def test_small_and_odd_tables(spark):
    few = [(i, [float(i), 2.0, 0.0, -1.0, 1.0, 1.0, 3.0, 0.25], 0) for i in range(5)]
    assert result(vector_codes.compress(table(spark, few))) == brute(few)
    same = [(i, [0.5] * 8, None) for i in range(50)]
    assert result(vector_codes.compress(table(spark, same))) == brute(same)
    assert vector_codes.compress(table(spark, [])).collect() == []
    assert vector_codes.compress(table(spark, [(1, None, 1)])).collect() == []
    uneven = vector_codes.compress(table(spark, [(i, [float(i)] * 3, 1) for i in range(20)])).collect()
    assert len(uneven) == 20 and all(len(r.code) == 16 for r in uneven)
    huge = vector_codes.compress(table(spark, [(i, [3e38 * (-1) ** i] * 8, 1) for i in range(20)])).collect()
    assert len(huge) == 20


def test_stayers_are_not_moved(spark, monkeypatch):
    """A round's table has only the parts whose entry changes."""
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(200)]
    sizes, deal = [], vector_codes.Lloyd.deal

    def watched(self, parts):
        deal(self, parts)
        sizes.append(self.tables[-1].count())

    monkeypatch.setattr(vector_codes.Lloyd, "deal", watched)
    assert result(vector_codes.compress(table(spark, data))) == brute(data)
    assert sizes[0] == 200 * 8 and len(sizes) == 6 and all(n < 800 for n in sizes[1:])


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    names = "vec_id, code, error, label_error, codebooks_sha256"
    want = sorted(con.execute(f"SELECT {names} FROM ({queries.ORACLE['op12_resident_lloyd']})").fetchall())
    assert sorted(map(tuple, queries.op12_resident_lloyd(spark, SF).select(*names.split(", ")).collect())) == want
