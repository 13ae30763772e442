"""Gates: texts that pass none of them aren't searched, and lines are made for others only."""

from pyspark.sql import functions as F

from inkveil.functions.spans import any_literal, gate_literals, gates_sql, with_contexts
from inkveil.operators.detectors import IDENTITY_FIELDS, IDENTITY_PARTS
from inkveil.operators.scan import ScanOptions, _Plan, active_detectors, rule_matches


def test_one_pattern_for_many_literals(spark):
    literals = gate_literals(_Plan.of(active_detectors(ScanOptions())).patterns)
    made = [t for x in literals for t in (x, f"aa{x}", f"{x}{x[0]}", f"ß {x}\n", x[1:], x[:-1], f"{x[:-1]} {x[-1]}", f"{x[0]}{x}")]
    rows = spark.createDataFrame([(t,) for t in made], "t string").select("t", F.col("t").rlike(any_literal(literals)).alias("found")).collect()
    assert len(literals) > 30 and [r.found for r in rows] == [any(x in r.t for x in literals) for r in rows]


def test_prose_passes_no_gate(spark):
    patterns = _Plan.of(active_detectors(ScanOptions())).patterns
    text = "A plain line, with commas, and more of them.\nThen a second one, as plain as that, and a third."
    docs = spark.createDataFrame([(text, text.lower())], "t string, l string")
    gates = docs.select(F.expr(gates_sql("t", "l", "false", "false", patterns)).alias("g")).first().g
    assert len(gates) == len(with_contexts(patterns)) and not any(gates)


def test_identity_headers_pass_their_gate(spark):
    assert len([f for f in IDENTITY_FIELDS if not any(p in f for p in IDENTITY_PARTS)]) < 3
    texts = ["x\nStatus, Comments ,UPN\ny", "a, b\nstatus,comments,\"Deactivation Date\",'E-Mail'", "status,comments,status", "Vorname, Status, Ort"]
    rows = rule_matches(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), options=ScanOptions(frozenset(["csv-identity-header"]))).orderBy("id").collect()
    assert [[(m.start, m.value, m.confidence) for m in r.rule_matches] for r in rows] == [[(2, "Status, Comments ,UPN", "low")], [(5, texts[1][5:], "medium")], [], []]


def test_a_row_looks_at_the_gates_of_its_own_rule_alone(spark):
    plan = _Plan.of(active_detectors(ScanOptions(frozenset(["ipv4", "api-key", "network-port"]))), ())
    numbers = []
    made = plan.by_rule("rule", lambda own: numbers.append(list(own)) or gates_sql("t", "t", "true", None, plan.patterns, own), "cast(array() AS array<boolean>)")
    assert sorted(n for own in numbers for n in own) == list(range(len(with_contexts(plan.patterns)))) and len(numbers) == 3
    rows = spark.createDataFrame([("ipv4", "10.20.30.40"), ("api-key", "10.20.30.40"), ("none", "10.20.30.40")], "rule string, t string")
    got = {r.rule: r.g for r in rows.select("rule", F.expr(made).alias("g")).collect()}
    assert got == {"ipv4": [True], "api-key": [False] * 4, "none": []}


def test_texts_with_the_character_that_marks_cuts(spark):
    text = "\x01a 10.1.2.3\x01 b\x01 10.1.2.4\n\x01 c 10.1.2.5"
    plain = text.replace("\x01", "#")
    rows = rule_matches(spark.createDataFrame([(0, text), (1, plain)], "id int, text string"), options=ScanOptions(frozenset(["ipv4"]))).orderBy("id").collect()
    assert [[(m.start, m.value) for m in r.rule_matches] for r in rows] == [[(plain.index(v), v) for v in ("10.1.2.3", "10.1.2.4", "10.1.2.5")]] * 2
