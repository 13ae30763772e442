"""Near-dedup in the pipeline with repeated and null ids: one row of each component, and never none."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_one_row_of_each_component(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcdef"]
    near = texts[1].replace("b39", "other")
    rows = [
        (7, texts[0], "en"), (7, texts[1], "en"), (7, texts[2], "en"),  # one id, three texts that aren't linked
        (9, near, "en"), (None, texts[1], "fr"),  # with the second of them
        (None, texts[3], "en"), (None, texts[3], "en"), (None, texts[3], "de"),  # copies without any id
        (None, texts[4], "en"), (4, texts[4], "en"), (4, texts[4], "en"),
        (5, texts[5], "fr"), (5, texts[5], "en"),  # copies of one id
        (6, "", "en"), (6, "", "en"), (6, None, "en"), (None, None, "en"),  # without words
    ]
    want = [(7, texts[0], "en"), (7, texts[1], "en"), (7, texts[2], "en"), (None, texts[3], "de"), (4, texts[4], "en"), (5, texts[5], "en"), *rows[-4:]]
    for made in (rows, rows[::-1]):
        docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
        got = pipeline.near_dup_stage(spark, docs, "").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_mix_keeps_rows_apart(spark):
    """Rows that differ in other columns only, and equal rows: each is taken twice at most, none for another."""
    rows = [(1, "same words here", lang, "a", n) for lang in ("en", "fr", None) for n in (0, 1)] + [(1, "same words here", "en", "a", 0)] * 3 + [(2, "b " * n, "de", "b", n) for n in range(1, 30)] + [(None, None, None, None, None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long").withColumn("id", F.lit("taken"))
    got = pipeline.mixing_stage(spark, docs, "")
    assert got.columns == ["doc_id", "text", "lang", "source", "copy", "id", "_copy"]
    made = Counter(tuple(r)[:5] for r in got.collect())
    had = Counter(rows)
    assert set(made) <= set(had) and all(made[r] <= 2 * had[r] for r in made) and max(r[-1] for r in got.collect()) == 2
    # source b has more than its share of words, so a is taken twice throughout, whatever tells its rows apart
    assert {r: n for r, n in made.items() if r[3] == "a"} == {r: 2 * had[r] for r in had if r[3] == "a" and r[1]}
    again = pipeline.mixing_stage(spark, docs.repartition(5), "")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got.collect()))
