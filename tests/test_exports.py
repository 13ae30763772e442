"""Exports of many documents: all or nothing, and no text overwrites another."""

import os

import pytest
from pyspark.sql import functions as F

from inkveil.operators import review
from inkveil.operators.render import sanitize
from inkveil.operators.scan import scan
from inkveil.sources import exports
from inkveil.sources.lists import PACKAGE_NAMES

SCHEMA = "id string, name string, text string"


@pytest.fixture
def source(spark):
    exports.register(spark)
    return spark


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), newline="", encoding="utf-8").read() for d, _, names in os.walk(root) for f in names}


def by_document(root):
    """Of each (folder of a document, name) the texts."""
    made = {}
    for path, text in files(root).items():
        run, _, folder, name = path.split("/")
        assert run.startswith(("run-", "batch-"))
        made.setdefault((folder, name), []).append(text)
    return {k: sorted(v) for k, v in made.items()}


def save(rows, root):
    rows.write.format(exports.FORMAT).mode("append").save(str(root))


def test_packages(source, tmp_path):
    docs = source.createDataFrame([(i, f"mail u{i}@x.example\r\n") for i in range(40)] + [(7, None)], "doc_id long, text string").repartition(5)
    reviewed = review.findings_summary(review.readiness(review.export_aggregates(sanitize(scan(docs)))))
    save(exports.packages(reviewed), tmp_path)
    got = by_document(tmp_path)
    assert len([d for d, n in got if n == PACKAGE_NAMES[0]]) in (40, 41) and sum(map(len, got.values())) == 41 * 3
    assert got["doc-3", PACKAGE_NAMES[0]] == ["mail [EMAIL_1]\r\n"] and got["doc-3", PACKAGE_NAMES[2]] == [review.review_checklist()]
    assert sorted(t for (d, n), ts in got.items() if d.startswith("doc-7") and n == PACKAGE_NAMES[0] for t in ts) == ["", "mail [EMAIL_1]\r\n"]


def test_ids_and_repeats(source, tmp_path):
    name = PACKAGE_NAMES[1]
    rows = [("a/../b", name, "1"), ("a/../b", name, "2"), ("..", name, "3"), (None, name, None), ("a@2", name, "4"), ("é", name, "x" * 300_000)]
    save(source.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("path", F.lit(1)), tmp_path)
    got = {d: t for (d, _), t in by_document(tmp_path).items()}
    assert got == {"doc-a%2F..%2Fb": ["1"], "doc-a%2F..%2Fb@2": ["2"], "doc-..": ["3"], "doc": [""], "doc-a%402": ["4"], "doc-%C3%A9": ["x" * 300_000]}
    save(source.createDataFrame([], SCHEMA), tmp_path)
    assert len(files(tmp_path)) == len(rows)


def test_a_failure_leaves_nothing(source, tmp_path):
    rows = source.createDataFrame([(str(i), PACKAGE_NAMES[0] if i != 37 else "other.txt", "t") for i in range(40)], SCHEMA).repartition(4)
    with pytest.raises(Exception, match="not an export: other.txt"):
        save(rows, tmp_path)
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="use mode append"):
        rows.write.format(exports.FORMAT).mode("overwrite").save(str(tmp_path))
    with pytest.raises(Exception, match="missing: text"):
        save(rows.drop("text"), tmp_path)


def test_stream_reads_each_file_once(source, tmp_path):
    read, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = source.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(read)
        rows = stream.select(F.col("doc_id").cast("string").alias("id"), F.lit(PACKAGE_NAMES[0]).alias("name"), "text")
        query = rows.writeStream.format(exports.FORMAT).option("checkpointLocation", state).trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)

    for i in range(3):
        source.createDataFrame([(i, f"text {i}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(read)
        if i:
            run()
    run()
    assert by_document(out) == {(f"doc-{i}", PACKAGE_NAMES[0]): [f"text {i}"] for i in range(3)}
    assert sorted(os.listdir(out)) == ["batch-0", "batch-1", "batch-2"]


def test_a_failed_stream_leaves_nothing_and_goes_on(source, tmp_path):
    read, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    source.createDataFrame([(str(i), PACKAGE_NAMES[0], "t") for i in range(20)], SCHEMA).repartition(4).write.parquet(read)

    def run(bad):
        stream = source.readStream.schema(SCHEMA).parquet(read)
        rows = stream.withColumn("name", F.when(F.lit(bad) & (F.col("id") == "7"), "other.txt").otherwise(F.col("name")))
        rows.writeStream.format(exports.FORMAT).option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(120)

    with pytest.raises(Exception, match="not an export"):
        run(True)
    assert not os.path.isdir(out) or os.listdir(out) == []
    run(False)
    assert len(by_document(out)) == 20 and os.listdir(out) == ["batch-0"]
