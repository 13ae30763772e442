"""Several choices of rules over one search of the texts."""

import re

import pytest

from inkveil.operators import render, terms
from inkveil.operators.scan import ScanOptions, scan, scan_choices
from inkveil.plans import catalogue

TEXTS = ["ZephAccess and 'Zeph' $zeph of a.b@x.example at 10.20.30.40", "Zeph\nZEPH_A = 'it''s Zeph' # Enable-Zeph", "nothing", None]


def _choices():
    rules = {s: terms.mapping_detectors([terms.MappingEntry("Zeph", "SourceSystem", strategy=s)]) for s in terms.STRATEGIES}
    return {s: ScanOptions(frozenset(["email"] if s == "placeholder" else ["ipv4"]), r) for s, r in rules.items()} | {"none": ScanOptions(frozenset())}


def test_choices_are_separate_scans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    made = render.compare_modes(scan_choices(docs, _choices()))
    rows = made.collect()
    assert len(rows) == 5 * len(TEXTS)
    for name, options in _choices().items():
        alone = {r.doc_id: r for r in render.compare_modes(scan(docs, options=options)).collect()}
        for r in rows:
            if r.choice == name:
                assert {k: v for k, v in r.asDict(True).items() if k != "choice"} == alone[r.doc_id].asDict(True)


def test_choices_must_fit(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        scan_choices(docs, {"a": ScanOptions(), "b": ScanOptions(template="[X]")})
    a, b = (terms.mapping_detectors([terms.MappingEntry(t, "Name")])[0] for t in ("one", "two"))
    with pytest.raises(ValueError):
        scan_choices(docs, {"a": ScanOptions(extra=(a, b)), "b": ScanOptions(extra=(b, a))})


def test_output_modes_read_documents_once(spark):
    plan = catalogue.q_output_modes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and len(re.findall(r"regexp_extract_all\(_scan_text[^,]*, \(\?iu\)Zeph, 0\)", plan)) == 1
