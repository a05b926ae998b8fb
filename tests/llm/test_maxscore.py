import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contamgraph.llm import maxscore as M


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in ok if i % every == 0}):
        q = next(v for j, v in ok if j == i)
        hits = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def data(n=300, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, dims)) / 4).astype(np.float32)
    v[10:20] = v[5]
    return [(i, [float(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("shard", [8192, 40])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(M, "SHARD_ROWS", shard)
    monkeypatch.setattr(M, "QUERY_ROWS", 7)
    rows = data()
    rows += [(1000, None), (1001, [float("nan")] * 16), (1050, [None] * 16), (1100, [float("inf")] * 16), (None, rows[0][1]), (1150, []), (1200, [0.0] * 16), (1201, [1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    got = M.top_k(df, every=25)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5, 25)


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, M.top_k(df).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, -256 * 256)]


def test_large_components_are_exact():
    q = np.array([[2.0**30, 1.0, -(2.0**31)]])
    v = np.array([[2.0**31, 1.0, 3.0], [2.0**31, 2.0, 3.0], [2.0**31, 0.0, 3.0]])
    hits = M.top_of_shard(q, np.array([9]), v, np.array([1, 2, 3]), 2)
    assert hits == [(9, 2, 2**61 + 2 - 3 * 2**31), (9, 1, 2**61 + 1 - 3 * 2**31)]


def test_pruning_never_changes_the_result():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(6000, 24)) * 60)
    q = np.floor(rng.normal(size=(5, 24)) * 60)
    ids = rng.permutation(6000)
    got = M.top_of_shard(q, np.arange(-5, 0), v, ids, 7)
    want = []
    for a in range(5):
        s = v @ q[a]
        want += [(a - 5, int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s))[:7]]
    assert got == want


def test_empty_table(spark):
    assert M.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_ROWS", 50)
    monkeypatch.setattr(M, "QUERY_ROWS", 3)
    monkeypatch.setattr(M, "GROUP_BYTES", 1000)
    rows = data(200, 8) + [(0, data(20, 8, 9)[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, M.top_k(df.where("vec_id > 0"), every=10).collect()))
    assert got == brute([r for r in rows if r[0] > 0], 5, 10)
    assert M.top_k(df, every=10).where("query_id = 0").count() == 5
