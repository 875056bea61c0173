import math

import numpy as np

from quillon.llm import embeddings as emb

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int, block string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def vectors(n=300, dim=16):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i % 3 and rows:
            v = np.array(rows[i - i % 3][1]) + rng.normal(size=dim) * 0.08
        rows.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 3 == 0 else rows[i - i % 3][2]))
    rows += [(1000, None, 1), (1001, [0.0] * dim, 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] * dim, 1), (1004, rows[0][1], None), (1005, rows[0][1], rows[0][2]), (5, rows[5][1], rows[5][2]), (1006, [1.0, None], 1), (1007, [1.0], 1), (1050, rows[0][1], 1)]
    return rows


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rows = vectors()
    n, root = [0] * len(rows), list(range(len(rows)))
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows[:i]):
            if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                a64, b64 = np.array(a), np.array(b)
                if a64 @ b64 / np.linalg.norm(a64) / np.linalg.norm(b64) >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    comp = [min(rows[k][0] for k in range(len(rows)) if root[k] == root[i]) for i in range(len(rows))]
    want = sorted((r[0], n[i], comp[i], comp[i] == r[0]) for i, r in enumerate(rows))
    assert sum(n) > 100
    monkeypatch.setattr(emb, "RECALL", 1 - 1e-9)
    for block in (1024, 8):
        monkeypatch.setattr(emb, "BLOCK", block)
        got = sorted(tuple(r) for r in emb.near_duplicate_vectors(table(spark, rows)).collect())
        assert got == want
    assert emb.near_duplicate_vectors(table(spark, []).limit(0)).count() == 0


def test_many_copies_of_one_vector_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK", 8)
    monkeypatch.setattr(emb, "RECALL", 1 - 1e-9)
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(100 + i, base, 1) for i in range(300)] + [(5, [1.0, 2.0, 3.0, 4.1], 1), (6, base, 2), (7, [-4.0, 3.0, -2.0, 1.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in emb.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == {100 + i: (300, 5, False) for i in range(300)} | {5: (300, 5, True), 6: (0, 6, True), 7: (0, 7, True)}


def test_top_k_against_brute_force(spark):
    rows = vectors()
    ints = [(r[0], [math.floor(256 * x) for x in r[1]]) for r in rows if usable(r[1])]
    want = []
    for i, (q, a) in enumerate(ints):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for j, (v, b) in enumerate(ints) if j != i and len(a) == len(b))[:5]
            want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(scores)]
    for shard, queries in ((16384, 16384), (40, 2), (7, 3)):
        got = sorted(tuple(r) for r in emb.top_k(table(spark, rows), shard=shard, queries=queries).collect())
        assert got == sorted(want)
    wide = [(i, [x * 2.0**40 for x in r[1]], 1) for i, r in enumerate(rows[:120])]  # beyond what doubles hold exactly
    exact = [[math.floor(256 * x) for x in v] for _, v, _ in wide]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in emb.top_k(table(spark, wide), shard=30).collect()}
    for q in (0, 50, 100):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(exact[q], v, strict=True)))), i) for i, v in enumerate(exact) if i != q)[:5]
        assert [got[q, k + 1][1] for k in range(5)] == [-s for s, _ in scores]
    few = emb.top_k(table(spark, rows[:3])).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert emb.top_k(table(spark, []).limit(0)).count() == 0
