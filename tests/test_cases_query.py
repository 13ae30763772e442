"""q_detector_cases on documents that share ids, and without a shuffle of what is found."""

import duckdb

from inkveil.plans import catalogue


def test_shared_and_missing_ids(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.q_detector_cases(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(doc_id" in plan
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    wanted = db.execute(f"SELECT doc_id, rule, value, confidence, count FROM ({catalogue.oracle_sql()['q_detector_cases']})").fetchall()
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    rows = got.select("doc_id", "rule", "value", "confidence", "count").collect()
    assert key(rows) == key(wanted) and max(r["count"] for r in rows) >= 4
