import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from . import test_decontaminate, test_near_dup, test_substring_dedup  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        made = stage(spark, docs, DATA)
        made.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        assert after.columns[: len(columns)] == columns
        rows = {r.doc_id: r.text for r in docs.collect()}
        left = {r.doc_id: r.text for r in after.collect()}
        pairs = sorted(rows.items())
        if name == "near_dedup":
            assert set(left) == {k for k, _, _, kept in test_near_dup.brute(pairs) if kept}
        elif name == "substring_dedup":
            want = {k: kept if gone else rows[k] for k, n, gone, kept in test_substring_dedup.brute(pairs, 35) if gone < n or not n}
            assert left == want
        elif name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(left) == set(rows) - {k for k, *_ in test_decontaminate.brute(pairs, bench)}
        elif name == "mixing":
            assert set(left) <= set(rows) and after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
        else:
            assert 0.7 * len(rows) < len(left) < len(rows) and set(left) <= set(rows)
        seen.append(len(left))
        docs = after
    assert sorted(map(tuple, pipeline.run(spark, DATA).collect())) == sorted(map(tuple, docs.collect()))


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b c", "en", None, 5), (None, "", "en", "x", 0), (3, "long word " * 3000, "en", "x", 1), (3, "long word " * 3000, "en", "x", 1)]
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema) if stage is not pipeline.mixing_stage else stage(spark, docs, DATA)
        assert docs.count() <= 2 * n
