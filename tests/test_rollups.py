"""Counts over micro-batches equal the batch's, with repeated and late rows and over a restart."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from inkveil.streaming.rollups import tally_windows, write_tally

SCHEMA = "doc_id long, ts timestamp, text string, category string"
TEXTS = ("a@b.example and 10.20.30.40", None, "", "nothing", "x@y.example x@y.example")


def row(i, minute):
    return i, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minute), TEXTS[i % len(TEXTS)], "clash"


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_micro_batches_equal_the_batch(spark, tmp_path):
    read, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    steps = [
        [row(i, i) for i in range(20)],
        [row(i, i) for i in range(10, 40)],  # rows that come again
        [row(i, i - 8) for i in range(50, 60)] + [(99, None, "a@b.example", "")],  # out of order, within the delay
        [row(1000, 600)],  # closes what is open
    ]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(read)
        assert write_tally(stream, out, state, "10 minutes", "20 minutes").awaitTermination(180)

    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(read)
        if n != 1:
            run()
    made = spark.read.parquet(out)
    every = spark.createDataFrame([r for rows in steps[:-1] for r in rows], SCHEMA)
    assert told(made) == told(tally_windows(every, "10 minutes", "20 minutes")) != []
    total = made.filter("category IS NULL").agg(F.sum("documents"), F.sum("findings"), F.sum("without_findings")).first()
    distinct = {r[:3] for rows in steps[:-1] for r in rows if r[1]}
    assert tuple(total) == (len(distinct), sum((t or "").count("@") + (t or "").count("10.20") for _, _, t in distinct), sum("@" not in (t or "") for _, _, t in distinct))

    spark.createDataFrame([row(3, 3), row(2000, 1200)], SCHEMA).coalesce(1).write.mode("append").parquet(read)  # one far too late
    run()
    again = spark.read.parquet(out)
    assert told(again.filter("start < '2024-01-01 10:00:00'")) == told(made)
    assert again.groupBy("start", "category", "detector_id").count().filter("count > 1").isEmpty()
