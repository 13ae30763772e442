"""Names, terms, mappings, labelled fields, protected patterns, candidates and lists, on small invented texts."""

import re

import pytest
from pyspark.sql import functions as F

from inkveil.functions.script import string_literals, switch_patterns
from inkveil.operators import names, render, terms
from inkveil.operators.candidates import acronyms, candidates, title_runs
from inkveil.operators.scan import ScanOptions, scan
from inkveil.sources.lists import dump_list, load_list, parse_lines


def values(spark, texts, detect):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    made = rows.select("i", "text", detect(F.col("text")).alias("s")).collect()
    for r in made:
        assert all(r.text[s.start : s.end] == s.value for s in r.s), r
    return [[s.value for s in r.s] for r in sorted(made, key=lambda r: r.i)]


def test_person_names(spark):
    cases = [
        ("Owner: Dana Whitfield", ["Dana Whitfield"]),
        ('"display_name": "Ana de la Cruz Jr."', ["Ana de la Cruz Jr."]),
        ("Name = Priya", ["Priya"]),
        ("Owner: $owner", []),
        ("Manager: Get-Random", []),
        ("氏名 name: 田中太郎", ["田中太郎"]),
        ("# Written by Omar Haddad for the audit", ["Omar Haddad"]),
        ("As per Lena Brandt, the disk was full.", ["Lena Brandt"]),
        ("escalated to Support Team today", []),
        ("see Dr. Okafor about it", ["Okafor"]),
        ("Kind regards,\nMaya Lindqvist\nSales", ["Maya Lindqvist"]),
        ("the contact is 'Iris Novak' there", ["Iris Novak"]),
        ("Set-Thing -Name 'Iris Novak'", []),
        ("Iris Novak wrote from iris.novak@mail.example.org", ["Iris Novak"]),
        ("Build Release wrote from build.release@mail.example.org", []),
        ("First Name,Last Name,City\nIris,Novak,Brno\n\"Ada\",Quill,Oslo\n", ["Iris", "Novak", "Ada", "Quill"]),
        ("nothing to see here", []),
        ("", []),
    ]
    assert values(spark, [c[0] for c in cases], names.person_names) == [c[1] for c in cases]


def test_organization_names(spark):
    cases = [
        ("Company: Blue Heron Labs", ["Blue Heron Labs"]),
        ("Client: TBD", []),
        ("Department: 1234", []),
        ("# script for Cedar Valley Health by Kim", ["Cedar Valley Health"]),
        ("# script for Cedar Valley Health today", []),
        ("Copyright (c) 2019-2021 Juniper Works. All rights reserved", ["Juniper Works"]),
        ("a visit to Saint Olga Hospital, again", ["Saint Olga Hospital"]),
        ("in 2020 Marlin & Sons Ltd closed", ["Marlin & Sons Ltd"]),
        ("Vendor,Count\nOak Street Supplies,3\n", ["Oak Street Supplies"]),
        ("the hospital was full", []),
    ]
    assert values(spark, [c[0] for c in cases], names.organization_names) == [c[1] for c in cases]


def test_terms_fold_spellings_and_share_placeholders(spark):
    rule = terms.terms_detector(["Rook's Nest", "x-ray team", "ab"], label="House")
    text = "rook’s  nest, ROOK'S NEST; X–ray team; tabs ab"
    found = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), options=ScanOptions(frozenset(), (rule,))).first().findings
    assert [(f.value, f.placeholder) for f in found] == [("rook’s  nest", "[HOUSE_1]"), ("ROOK'S NEST", "[HOUSE_1]"), ("X–ray team", "[HOUSE_2]"), ("ab", "[HOUSE_3]")]


def test_term_lists_are_checked():
    parsed = terms.analyze_terms("alpha\n\na\nALPHA\n" + "b" * 121 + "\nlonger term")
    assert parsed == terms.ParsedTerms(("longer term", "alpha"), (4,), (3,), (5,), ())
    assert len(terms.analyze_terms("\n".join(f"term {i}" for i in range(130))).terms) == 100
    assert parse_lines("a1\r\n\na1\nB2", ["b2"]).__dict__ == {"terms": ("b2", "a1"), "added": 1, "empty": 1, "duplicate": 2, "too_long": 0, "capped": False}


@pytest.mark.parametrize(
    ("strategy", "safe", "code"),
    [
        ("placeholder", "[CUSTOM_TERM_1]Access and '[CUSTOM_TERM_1]' $[CUSTOM_TERM_1]", "[CUSTOM_TERM_1]Access and '[CUSTOM_TERM_1]' $[CUSTOM_TERM_1]"),
        ("code-only", "[CUSTOM_TERM_1]Access and '[CUSTOM_TERM_1]' $[CUSTOM_TERM_1]", "SourceSystemAccess and '[CUSTOM_TERM_1]' $sourceSystem"),
        ("genericize", "[CUSTOM_TERM_1]Access and '[CUSTOM_TERM_1]' $[CUSTOM_TERM_1]", "SourceSystemAccess and 'SourceSystem' $sourceSystem"),
        ("review-lead", "ZephAccess and 'Zeph' $zeph", "ZephAccess and 'Zeph' $zeph"),
    ],
)
def test_mapping_strategies(spark, strategy, safe, code):
    rules = terms.mapping_detectors([terms.MappingEntry("Zeph", "SourceSystem", strategy=strategy)])
    docs = spark.createDataFrame([(1, "ZephAccess and 'Zeph' $zeph")], "doc_id long, text string")
    row = render.compare_modes(scan(docs, options=ScanOptions(frozenset(), rules))).first()
    assert (row.safe_share, row.portfolio_code) == (safe, code)


def test_mappings_are_checked():
    entry = terms.MappingEntry
    assert terms.mapping_problem(entry("ok", "9bad")) and terms.mapping_problem(entry("x", "Good")) and terms.mapping_problem(entry("term"))
    kept = terms.usable_mappings([entry("Ab", "X"), entry("aB", "Y"), entry("Abcd", "Z"), entry("Ab", "W", match_mode="literal")])
    assert [(e.term, e.replacement) for e in kept] == [("Abcd", "Z"), ("Ab", "X"), ("Ab", "W")]
    assert terms.clean_mapping({"term": " t1 ", "replacement": "New", "codeSafe": False}).strategy == "placeholder"
    assert terms.clean_mapping({"term": "t"}) is None and terms.clean_mapping("no") is None


def test_capitals_become_snake_case(spark):
    rules = terms.mapping_detectors([terms.MappingEntry("zeph", "SourceSystem")])
    docs = spark.createDataFrame([(1, "$ZEPH_DB = $x.Zeph # Enable-Zeph\nfunction zeph {")], "doc_id long, text string")
    row = render.compare_modes(scan(docs, options=ScanOptions(frozenset(), rules))).first()
    assert row.portfolio_code == "$SOURCE_SYSTEM_DB = $x.SourceSystem # Enable-SourceSystem\nfunction sourceSystem {"


def test_field_rules(spark):
    rule = terms.FieldRule("r", "Badge", ("badge", "badge id"), "identifier", "BADGE_ID", max_length=8)
    text = "Badge ID: A-77\nbadge='B-12' badge = $x badge: Get-Thing badge: C123456789"
    assert values(spark, [text], terms.field_detector("p", rule).detect) == [["A-77", "B-12"]]
    assert values(spark, [text], lambda t: terms.skipped_values(rule, t)) == [["C123456789"]]
    free = terms.FieldRule("t", "Note", ("note",), "text", "NOTE")
    assert values(spark, ['note: "one two " x\nnote: three four  \nnote: $y'], terms.field_detector("p", free).detect) == [["one two", "three four"]]
    assert terms.field_rule_problem(rule) is None and terms.field_rule_problem(terms.FieldRule("r", "n", ())) and terms.field_rule_problem(terms.FieldRule("r", "n", ("a",), max_length=0))


def test_literals_and_switch_patterns(spark):
    text = "# it's\n$a = 'x ''y' + \"b `\" c\"\n'open"
    assert values(spark, [text], string_literals) == [["x ''y", 'b `" c', "open"]]
    block = "switch -Regex ($v) {\n  '^10\\.' { if ($q) { '}' } }\n  \"b+\" { 1 }\n}\n'^no' { }"
    assert values(spark, [block, "switch ($v) {\n '^a' { } }"], switch_patterns) == [["'^10\\.'", '"b+"'], []]


def test_candidates(spark):
    text = "The Juniper Desk asked Juniper Desk and the Board of Cedar Trust (JXQ). See JXQ, CSV and Monday. Active Directory is fine: Access"
    assert values(spark, [text], acronyms) == [["JXQ", "JXQ"]]
    assert values(spark, [text], title_runs) == [["The Juniper Desk", "Juniper Desk and the Board of Cedar Trust", "See", "Active Directory"]]
    docs = scan(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"))
    rows = candidates(docs, dismissed=["jxq"]).orderBy("rank").collect()
    assert "JXQ" not in {r.text for r in rows}
    assert [r.text for r in rows if r.generic] == ["Active Directory"] and rows[-1].generic
    assert {r.doc_id for r in rows} == {1}


def test_lists_round_trip():
    made = terms.TermList("Ours", ("one term",), (terms.MappingEntry("two", "Second", id="m1"),), True, False, "HOUSE")
    assert load_list(dump_list(made)) == made
    for bad in ("{", "[]", '{"kind": "other"}', dump_list(terms.TermList("Ours")), dump_list(terms.TermList(" ", ("aa",)))):
        with pytest.raises(ValueError):
            load_list(bad)


def plain_candidates(text, taken):
    """The suggestions in plain Python: words one by one, as the description of the operator says."""
    from inkveil.operators import candidates as C
    from inkveil.operators.names import STOP_WORDS

    free = lambda a, b: not any(a < e and s < b for s, e in taken)
    words = [(m.start(), m.group()) for m in re.finditer(r"\S+", text)]
    plain = {*STOP_WORDS, *C.CALENDAR, *C.COLORS, *C.KEYWORDS, *C.PLAIN_WORDS}
    found, i = [], 0
    while i < len(words):
        at, word = words[i]
        m = re.fullmatch(r"""([(\[{"'“‘]*)([A-Z][a-z]+)([)\]}"'”’.,;!?]*)""", word)
        if not m:
            i += 1
            continue
        start = at + len(m.group(1))
        end, last, caps = start + len(m.group(2)), i, [m.group(2)]
        j, ended = i + 1, bool(m.group(3))
        while not ended and j < len(words):
            if not re.fullmatch(r"[^\S\r\n]+", text[words[j - 1][0] + len(words[j - 1][1]) : words[j][0]]):
                break
            core = words[j][1].lstrip("([{\"'“‘")
            if core.lower() in C.CONNECTORS:
                j += 1
                continue
            n = re.fullmatch(r"""([A-Z][a-z]+)([)\]}"'”’.,;!?]*)""", core)
            if not n:
                break
            end, last, ended = words[j][0] + len(words[j][1]) - len(core) + len(n.group(1)), j, bool(n.group(2))
            caps.append(n.group(1))
            j += 1
        if end - start <= C.MAX_LENGTH and any(w.lower() not in plain for w in caps) and free(start, end):
            found.append((0, start, text[start:end], len(caps)))
        i = last + 1
    for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Z]{2,6}(?![A-Za-z0-9_])", text):
        if m.group() not in C.NO_ACRONYMS and free(*m.span()):
            found.append((1, m.start(), m.group(), 0))
    groups = {}
    for f in sorted(found):
        groups.setdefault(re.sub("[ \t\u00a0]+", " ", f[2]).lower(), []).append(f)
    rows = []
    for key, fs in groups.items():
        several, at_once = any(f[3] >= 2 for f in fs), any(f[0] == 1 or f[3] >= 2 for f in fs)
        if at_once or len(fs) >= 2:
            rows.append((key in C.GENERIC_PHRASES, not several, -len(fs), min(f[1] for f in fs), fs[0][2]))
    return [(i, r[4], -r[2], r[3], r[0]) for i, r in enumerate(sorted(rows)[: C.MAX_CANDIDATES], 1)]


def test_candidates_of_all_documents(spark):
    docs = scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")).cache()
    got = {}
    for r in candidates(docs).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], r.text, r["count"], r.first_start, r.generic))
    for r in docs.collect():
        assert sorted(got.get(r.doc_id, [])) == plain_candidates(r.text or "", [(f.start, f.end) for f in r.findings]), r.doc_id


def test_runs_of_any_length(spark):
    long = " ".join(["Juniper Cedar of"] * 3000) + " Desk.\nBlue Heron of the (Oak) and x Elm \t(Ash of\u00a0Yew: Fir Desk, Sky"
    assert values(spark, [long], title_runs) == [["Blue Heron of the (Oak", "Elm \t(Ash", "Fir Desk", "Sky"]]
    short = "x " * 70 + "Blue" + " Sky" * 29 + ", Blue" + " Sky" * 30
    assert values(spark, [short], title_runs) == [["Blue" + " Sky" * 29]]


def test_terms_with_signs(spark):
    """Characters that mean something to patterns or to SQL."""
    text = "O'Brien's ${env} costs \\d+ and 50% (net) -- x;y 'q' \"r\" {z} `t` ´u´ a\\'b"
    for term in ("O'Brien", "${env}", "\\d+", "50%", "(net)", "-- x;y", "'q'", '"r"', "{z}", "`t`", "´u´", "\\'b"):
        rules = (terms.mapping_detectors([terms.MappingEntry(term, strategy="placeholder", match_mode="literal")])[0], terms.terms_detector([term], inside_words=True))
        for rule in rules:
            found = scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), options=ScanOptions(frozenset(), (rule,))).first().findings
            assert [f.value for f in found] == [term], (term, rule.id)
    rule = terms.FieldRule("r", "Badge", ("o'badge", "${x}"), "identifier", "BADGE_ID")
    assert values(spark, ["O'Badge: A-77 ${x}: B-1"], terms.field_detector("p", rule).detect) == [["A-77", "B-1"]]
