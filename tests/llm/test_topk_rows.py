"""op10 with rows that share an id: every row is a candidate and a query, as its SQL has it."""

import random

import pytest

from inkveil.llm import topk as T

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("block, queries", [(T.BLOCK_ROWS, T.QUERY_ROWS), (7, 2)])
def test_repeated_ids(spark, tmp_path, monkeypatch, block, queries):
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    monkeypatch.setattr(T, "QUERY_ROWS", queries)
    rng = random.Random(3)
    vector = lambda: [rng.choice((-1.0, -0.5, 0.25, 1.0)) for _ in range(4)]
    rows = [(i, vector()) for i in (*range(30), 100, 200, 300)] + [(i, vector()) for i in (7, 100, 100, 5) for _ in range(9)]
    rows += [(8, [3.0, 3.0, 3.0, 3.0])] * 4 + [(200, [-2.0, 2.0, -2.0, 2.0])] * 3 + [(None, [9.0] * 4), (9, None), (9, [None, 1.0, 1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, T.op10_topk(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(T.OP10_SQL).fetchall())
    assert got == want and len(want) == 40
