"""Search by lines: what each rule finds line by line is what its patterns find in the whole text."""

from pyspark.sql import functions as F

from inkveil.functions.spans import lines_of
from inkveil.operators.detectors import registry
from inkveil.operators.scan import ScanOptions, rule_matches
from inkveil.plans.catalogue import RULE_CASES, _case_text


def test_lines_have_places(spark):
    rows = spark.createDataFrame([("a\n\nßİ\r\n€x",), ("",)], "t string").select(lines_of(F.col("t"), F.lower("t")).alias("x")).collect()
    assert [[(y.at, y.t) for y in r.x] for r in rows] == [[(0, "a"), (1 + 1, ""), (3, "ßİ\r"), (7, "€x")], [(0, "")]]


def test_lines_find_what_whole_texts_have(spark):
    cases = "concat_ws({0}, " + ", ".join(_case_text(rule) for rule in RULE_CASES) + ", 'password =', '\"hunter22\"', 'user:', 'kim2', 'ver', '10.2.3.4', 'Kind regards,', 'Dana Whitfield', {0})"
    made = [cases.format(sep) for sep in ("chr(10)", "chr(13) || chr(10)", "' some words with İ' || chr(10) || chr(10)", "' '")]
    docs = spark.range(3, numPartitions=3).withColumnRenamed("id", "doc_id").select("doc_id", F.explode(F.array(*map(F.expr, made))).alias("text"))
    rules = [d for d in registry() if not d.special]
    scanned = rule_matches(docs, options=ScanOptions(frozenset(d.id for d in rules)))
    over_lines = 0
    for r in scanned.select("rule_matches", *(d.detect(F.col("text")).alias(d.id) for d in rules)).collect():
        for d in rules:
            assert sorted((m.start, m.end, m.value) for m in r.rule_matches if m.detector_id == d.id) == sorted((m.start, m.end, m.value) for m in r[d.id]), d.id
        over_lines += "hunter22" in [m.value for m in r.rule_matches]
    assert over_lines == 9


def test_one_rule_of_a_row(spark):
    docs = spark.createDataFrame([("email", "a.b@x.example at 10.20.30.40"), ("ipv4", "a.b@x.example at 10.20.30.40")], "rule string, text string")
    rows = rule_matches(docs, options=ScanOptions(frozenset(["email", "ipv4"])), only="rule").collect()
    assert {r.rule: [m.value for m in r.rule_matches] for r in rows} == {"email": ["a.b@x.example"], "ipv4": ["10.20.30.40"]}
