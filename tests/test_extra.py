"""Rules in Python compete with native ones, and SQL can call them."""

import pytest
from pyspark.sql import functions as F

from inkveil.operators import extra as X
from inkveil.operators.render import sanitize
from inkveil.operators.scan import ScanOptions, finding_rows, scan

SCHEMA = "doc_id long, text string"


def words(text):
    """Words that read the same backwards, of three letters or more."""
    at = 0
    for word in text.split(" "):
        if len(word) > 2 and word == word[::-1]:
            yield at, at + len(word)
        at += len(word) + 1


def mailbox(text):
    at = text.find("@")
    if at > 0:
        yield at - 3, at


PALINDROME = X.PythonRule("palindrome", "Palindrome", "MIRROR", words, priority=10)
MAILBOX = X.PythonRule("mailbox", "Mailbox", "BOX", mailbox, priority=10_000)
TEXTS = [(1, "level a@b.example noon ab"), (1, "level a@b.example noon ab"), (2, None), (3, ""), (4, "\U0001f600 level to bob@x.example"), (5, "no " * 20_000 + "civic")]


def found(scanned):
    return sorted(tuple(r) for r in finding_rows(scanned).select("doc_id", "detector_id", "start", "value", "placeholder").collect())


def test_with_native_rules(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    got = found(X.scan_python(docs, [PALINDROME]))
    one = [(1, "email", 6, "a@b.example", "[EMAIL_1]"), (1, "palindrome", 0, "level", "[MIRROR_1]"), (1, "palindrome", 18, "noon", "[MIRROR_2]")]
    assert got == sorted([*one, *one, (4, "email", 11, "bob@x.example", "[EMAIL_1]"), (4, "palindrome", 2, "level", "[MIRROR_1]"), (5, "palindrome", 60_000, "civic", "[MIRROR_1]")])


def test_priority_decides(spark):
    docs = spark.createDataFrame([TEXTS[4]], SCHEMA)
    low = X.PythonRule("mailbox", "Mailbox", "BOX", mailbox, priority=0)
    assert found(X.scan_python(docs, [low])) == [(4, "email", 11, "bob@x.example", "[EMAIL_1]")]
    assert found(X.scan_python(docs, [PALINDROME, MAILBOX])) == [(4, "mailbox", 11, "bob", "[BOX_1]"), (4, "palindrome", 2, "level", "[MIRROR_1]")]
    assert sanitize(X.scan_python(docs, [MAILBOX])).first().clean_text == "\U0001f600 level to [BOX_1]@x.example"


def test_no_rules_no_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    assert found(X.scan_python(docs, [])) == found(scan(docs))
    assert found(X.scan_python(docs.limit(0), [MAILBOX])) == []
    assert X.scan_python(docs.withColumn("value", F.lit(1)), [MAILBOX]).columns[:3] == ["doc_id", "text", "value"]


def test_bad_ids_and_spans(spark):
    assert X.rules_problem([MAILBOX, MAILBOX]) == "Two rules have this id: mailbox"
    with pytest.raises(ValueError, match="A native rule has this id: email"):
        X.python_matches(F.col("text"), [X.PythonRule("email", "E", "E", words)])
    beyond = X.PythonRule("beyond", "B", "B", lambda t: [(0, len(t) + 1)])
    with pytest.raises(Exception, match="rule beyond: no span of the text: 0 to 3, of 2"):
        X.scan_python(spark.createDataFrame([(1, "ab")], SCHEMA), [beyond], ScanOptions(frozenset())).collect()


def test_table_function(spark):
    X.register_rules(spark, "own_spans", [PALINDROME, MAILBOX])
    spark.createDataFrame(TEXTS, SCHEMA).createOrReplaceTempView("texts_of_rules")
    rows = spark.sql("SELECT t.doc_id, m.* FROM texts_of_rules t, LATERAL own_spans(t.text) m")
    one = [(1, "mailbox", 4, 7, "l a"), (1, "palindrome", 0, 5, "level"), (1, "palindrome", 18, 22, "noon")]
    assert sorted(tuple(r) for r in rows.collect()) == sorted([*one, *one, (4, "mailbox", 11, 14, "bob"), (4, "palindrome", 2, 7, "level"), (5, "palindrome", 60_000, 60_005, "civic")])
