"""Guidance: every rule has some, and its sample shows what it finds; problems that keep lists and packs from being saved."""

from inkveil.operators.detectors import registry
from inkveil.operators.terms import MAX_TERM_LENGTH, MAX_TERMS, FieldRule
from inkveil.plans import guide
from inkveil.sources import lists


def test_every_rule_has_guidance_and_a_finding(spark):
    assert list(guide.GUIDE) == [d.id for d in registry()]
    assert all(len(x) == 3 and all(x) for x in guide.GUIDE.values())
    rows = guide.previews(guide.guide_table(spark)).collect()
    assert len(rows) == len(registry())
    for r in rows:
        assert [f.detector_id for f in r.findings] == [r.rule], r.rule
        assert all(f.placeholder in r.clean_text if f.enabled else f.value in r.clean_text for f in r.findings), r.rule


def test_defined_cases(spark):
    rows = guide.previews(spark.createDataFrame([(1, "mail a@b.example", 99), (1, "mail a@b.example", None), (2, None, 14), (3, "x " * 30_000 + "a@b.example", 14)], "doc_id long, sample string, ord int"))
    assert [(r.doc_id, len(r.findings)) for r in rows.orderBy("doc_id").collect()] == [(1, 0), (1, 0), (2, 0), (3, 1)]
    assert guide.previews(guide.guide_table(spark).limit(0)).collect() == []


def test_save_problems():
    assert lists.list_problem([]) == lists.list_problem([" ", "x" * (MAX_TERM_LENGTH + 1)]) == "A new list needs at least one usable term."
    assert lists.list_problem([], new=False) is None and lists.list_problem(["zeph"]) is None
    assert lists.pack_problem([], []) is not None and lists.pack_problem(["email"], []) is None
    assert lists.pack_problem([], [FieldRule("a", "A", ("a",), "text", "A")]) is None


def test_import_summary():
    end = "The terms are not stored unless you say so."
    assert lists.import_summary(lists.parse_lines("zeph\n\n")) == f"1 term added. {end}"
    assert lists.import_summary(lists.parse_lines("zeph\nZeph\nother\n" + "y" * 999)) == f"2 terms added; 2 left out. {end}"
    full = lists.parse_lines("\n".join(f"t{i:04}" for i in range(MAX_TERMS + 1)))
    assert lists.import_summary(full) == f"{MAX_TERMS} terms added; the list is full at {MAX_TERMS}. {end}"
