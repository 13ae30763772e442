import math

import pytest
from pyspark.sql import functions as F

from inkveil.llm import topk as T

DATA = "/root/testdata/sf0.01"


def brute(rows, k=10, every=100):
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in known if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for i, x in known if i == q for c, y in known if c != q and len(x) == len(y))
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, queries", [(T.BLOCK_ROWS, T.QUERY_ROWS), (60, 2)])
def test_embeddings(spark, monkeypatch, block, queries):
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    monkeypatch.setattr(T, "QUERY_ROWS", queries)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(0, [0.1, 0.2, 0.3]), (1, None), (2, []), (3, [None, 1.0, 2.0]), (4, [float("nan"), 1.0, 2.0]), (5, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (6, [0.5, 0.5]), (100, [-1.0, -1.0, 2.0]), (200, [0.3, 0.1]), (300, [9000.0, 1.0, 1.0])]
    rows += [(10 + i, [0.25, 0.25, 0.25]) for i in range(30)] + [(10, [0.25, 0.25, 0.25]), (11, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as dim", "2 as v", "3 as block")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows)
    assert T.top_k(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_long_vectors_and_large_components(spark):
    import random

    dice = random.Random(2)
    # sums beyond 53 bits, in more components than a float64 would be exact for
    rows = [(i, [dice.uniform(-3000, 3000) for _ in range(700)]) for i in range(0, 300, 20)] + [(i, [dice.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(1, 300, 33)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, T.top_k(df, F.col("vec_id") % 100 == 0).collect())) == brute(rows)


def test_products_keep_their_integers():
    import numpy as np

    for size, dim in ((2**20, 600), (2**26, 300), (2**29, 8), (2**31, 2), (2**40, 3)):
        x = np.array([[size - 1] * dim, [-size] * dim])
        assert T._product(x, x).tolist() == [[dim * a * b for b in (size - 1, -size)] for a in (size - 1, -size)]


def test_scores_to_64_bits(spark):
    """Up to the ends of 64 bits scores are what the SQL gives; beyond they stay at the ends."""
    import duckdb

    rows = [(0, [2.0**21, 2.0**20]), (1, [2.0**21, -(2.0**19)]), (2, [2.0**21, 2.0**20]), (3, [-(2.0**21), -(2.0**20)]), (4, [1.0, 0.5]), (5, [2.0**20.5, 2.0**20.5]), (100, [2.0**20, 2.0**21])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, T.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    assert got == sorted(con.execute(T.OP10_SQL).fetchall()) == brute(rows)
    assert max(s for *_, s in got) > 2**62
    held = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40]), (2, [-(2.0**40)]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in T.top_k(held, F.col("vec_id") == 0).orderBy("rank").collect()] == [2**63 - 1, 2**60, -(2**63)]


def test_the_bound_saves_products():
    import numpy as np

    dice = np.random.default_rng(3)
    c = np.floor(1024 * (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(dice.normal(size=(2000, 64)))).astype(np.int64)
    q = c[:50] + dice.integers(-40, 41, (50, 64))
    exact = q @ c.T
    bound = np.sort(exact, axis=1)[:, -10].astype(float)
    row, col, score, work = T.reaching(q, c, bound)
    assert {(r, k, s) for r, k, s in zip(row, col, score) if s >= bound[r]} == {(r, k, exact[r, k]) for r, k in zip(*np.nonzero(exact >= bound[:, None]))}
    assert work < 0.95 * exact.size * 64
    short = c.copy()
    short[100:] //= 16
    near = q @ short.T
    work = T.reaching(q, short, np.sort(near, axis=1)[:, -10].astype(float))[3]
    assert work < 0.6 * near.size * 64
