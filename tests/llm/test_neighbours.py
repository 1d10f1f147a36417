"""Vantage-point trees against all distances."""

import math
import random

import numpy as np
import pytest

from meterline.llm import neighbours
from meterline.llm.common import table

SCHEMA = "vec_id long, vec array<float>"


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        near = []
        for i, y in rows:
            if i != q and len(x) == len(y):
                total = 0.0
                for a, b in zip(x, y):
                    total += (a - b) * (a - b)
                near.append((math.sqrt(total), i))
        out[q] = sorted(near)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def vectors(n, wide, seed, copies=0):
    rnd = random.Random(seed)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(wide)]) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(copies)]


@pytest.mark.parametrize("copies", [0, 150])
def test_exact_with_factor_one(spark, copies):
    rows = vectors(300, 6, 1, copies)
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(neighbours.nearest(df, df.filter("vec_id % 10 = 0"), k=7, shard=60))
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 7)


def test_tree_prunes_and_factor_trades_recall():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(4000, 3)).astype(np.float32)
    ids = np.arange(4000)
    tree = neighbours.Tree.unpacked(neighbours.Tree.of(ids, points).packed())
    exact = tree.search(ids[:50], points[:50], 10, 1.0)[1]
    wide = points.astype(float)
    for q in range(50):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        assert set(exact[q]) == set(np.lexsort((ids, d))[:10])
    recall = [np.mean([len(set(a) & set(b)) / 10 for a, b in zip(tree.search(ids[:50], points[:50], 10, f)[1], exact)]) for f in (1.0, 2.0, 8.0)]
    assert recall[0] == 1.0 >= recall[1] >= 0.9 and recall[1] >= recall[2]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", score int, rank int")
    got = found(neighbours.nearest(df, df, k=3))
    assert got[0] == [(0.0, 7), (1.0, 9), (1.0, 9)] and got[9][0] == (1.0, 0)
    assert set(got) == {0, 7, 9}  # the only three-dimensional vector has no candidates
    assert found(neighbours.nearest(df.filter("false"), df)) == found(neighbours.nearest(df, df.filter("false"))) == {}


def test_recall_on_all_queries(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    got = found(neighbours.query(spark, folder))
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
