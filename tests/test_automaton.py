"""The automaton finds what the patterns of the same terms find."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import automaton as A
from inkveil.operators.render import sanitize
from inkveil.operators.scan import ScanOptions, scan
from inkveil.operators.terms import MATCH_MODES, STRATEGIES, MappingEntry, TermList, list_detectors

DATA = "/root/testdata/sf0.001"
TEXTS = [
    (1, "Zenith  Plan, zenith‐plan and ZENITH \tPLAN; zenithplan x_zenith_ 9zenith"), (1, "O’Neil o'neil O‘NEIL; ananana ANANA"), (2, None), (3, ""), (4, "\U0001f600 İstanbul istanbul ISTANBUL ıstanbul Straße STRASSE straße ſtrasse Kelvin kelvin"),
    (5, "$zenithId = 'zenith' + zenith_id; Get-Zenith zenith@x.example token = \"zenith-token-1\""), (6, "a  b\ta   b a b a-b a ‑ b"), (7, "ΣΊΓΜΑΣ σίγμας σίγμασ été été"), (8, "zenith " * 400),
]


def told(df):
    return sorted(((r.doc_id, r.text, r.clean_text, [tuple(f) for f in r.findings]) for r in sanitize(df, mode="portfolio-code").select("doc_id", "text", "clean_text", "findings").collect()), key=repr)


def lists():
    words = ("zenith plan", "Zenith-Plan", "zenith", "o'neil", "ana", "anana", "istanbul", "straße", "kelvin", "a b", "a - b", "σίγμας", "été", "été")
    mapped = tuple(MappingEntry(t, r, match_mode=m, strategy=s) for t, r, m, s in (("zenith", "Plan", "ci-literal", "code-only"), ("Zenith", "Other", "literal", "genericize"), ("zenith", "Word", "word", "review-lead"), ("İstanbul", "City", "word", "placeholder"), ("ana", "", "ci-literal", "placeholder")))
    yield TermList("plain", words)
    yield TermList("cased", words, case_sensitive=True)
    yield TermList("inside", words, mapped, inside_words=True, label="HIDDEN")
    yield TermList("mapped", (), mapped)


@pytest.mark.parametrize("terms", list(lists()), ids=lambda t: t.name)
def test_same_findings(spark, terms):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    assert told(A.scan_terms(docs, terms)) == told(scan(docs, options=ScanOptions(extra=list_detectors(terms))))


def test_same_findings_in_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    dice = random.Random(9)
    words = sorted({w for r in docs.limit(60).collect() for w in (r.text or "").split() if 3 <= len(w) <= 40})
    pick = dice.sample(words, 30)
    phrases = [" ".join((r.text or "").split()[:2]) for r in docs.limit(8).collect()]
    mapped = tuple(MappingEntry(w, f"Name{i}", match_mode=MATCH_MODES[i % 3], strategy=STRATEGIES[i % 4]) for i, w in enumerate(dice.sample(words, 12)))
    terms = TermList("many", (*pick[:18], *phrases), mapped)
    got = told(A.scan_terms(docs, terms))
    assert got == told(scan(docs, options=ScanOptions(extra=list_detectors(terms)))) and sum(len(r[3]) for r in got) > 200


def test_many_terms(spark):
    """A thousand needles beside each other; no list, and an empty table."""
    needles = [A.Needle(f"term{i}x", i, True, True, "") for i in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(f"Term{i}X" for i in range(0, 1000, 7)))], "doc_id long, text string")
    found = docs.select(F.explode(A.term_matches(F.col("text"), needles)).alias("m")).select("m.key", "m.value").collect()
    assert sorted(r.key for r in found) == list(range(0, 1000, 7)) and all(r.value == f"Term{r.key}X" for r in found)
    assert told(A.scan_terms(docs, TermList("none"))) == told(scan(docs))
    assert told(A.scan_terms(docs.limit(0), TermList("one", ("x y",)))) == []
