"""Detection, resolution, numbering, rendering, settings, review, files and streams."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.functions.spans import once
from inkveil.operators import render, review
from inkveil.operators.detectors import registry
from inkveil.functions import validators as V
from inkveil.operators.scan import ScanOptions, finding_rows, resolve, rule_matches, scan
from inkveil.plans import config, workspace
from inkveil.sources import files, lists, preferences
from inkveil.streaming.sanitize import write_sanitized

from .cases import CASES, CHECKSUMS

SCHEMA = "doc_id long, text string"


def scanned(spark, *texts, options=None):
    return scan(spark.createDataFrame(list(enumerate(texts, 1)), SCHEMA), options=options)


def test_registry_is_complete_and_in_order():
    ids = [d.id for d in registry()]
    assert len(ids) == len(set(ids)) == 49
    assert ids[:3] == ["private-key", "connection-string", "payment-card"] and ids[-1] == "csv-identity-header"


def test_every_rule_finds_its_case(spark):
    rows = spark.createDataFrame([c[:3] for c in CASES], "doc_id long, text string, rule string")
    made = rule_matches(rows, options=ScanOptions(frozenset(c[2] for c in CASES))).collect()
    ranges = scan(rows, options=ScanOptions(frozenset(c[2] for c in CASES))).collect()
    last = {(r.doc_id, r.rule): ([m.value for m in r.rule_matches if m.detector_id == r.rule] or [None])[-1] for r in made}
    kept = {r.doc_id: [f.value for f in r.findings] for r in ranges}
    for number, _, rule, value in CASES:
        assert last[number, rule] == value or (value is None and last[number, rule] not in kept[number]), (number, rule)


def test_checksums(spark):
    tests = {"iban": V.is_iban, "aba": V.is_aba, "dea": V.is_dea, "sin": V.is_sin, "ssn": V.is_ssn, "itin": V.is_itin, "card": V.is_card, "ipv6": V.is_ipv6}
    rows = spark.createDataFrame([c[:2] for c in CHECKSUMS], "kind string, value string")
    valid = F.coalesce(*(F.when(F.col("kind") == k, F.coalesce(t(F.col("value")), F.lit(False))) for k, t in tests.items()))
    assert sorted(map(tuple, rows.select("kind", "value", valid).collect())) == sorted(CHECKSUMS)


def greedy(spans):
    order = sorted(range(len(spans)), key=lambda i: (-spans[i][0], -spans[i][1], spans[i][2] - spans[i][3], spans[i][2], i))
    kept = []
    for i in order:
        if not any(spans[i][2] < spans[k][3] and spans[k][2] < spans[i][3] for k in kept):
            kept.append(i)
    return sorted(kept, key=lambda i: spans[i][2])


def test_resolution_is_greedy(spark):
    dice, sets = random.Random(5), []
    for _ in range(60):
        starts = [dice.randrange(40) for _ in range(dice.randrange(12))]
        sets.append([(dice.choice([50, 60, 70]), dice.randint(1, 3), a, a + dice.randint(1, 9)) for a in starts])
    rows = spark.createDataFrame([(n, [(*s, i) for i, s in enumerate(x)]) for n, x in enumerate(sets)], "n int, c array<struct<priority:int,confidence:int,start:int,end:int,i:int>>")
    got = {r.n: [k.i for k in r.kept] for r in once(rows, kept=resolve(F.col("c"))).collect()}
    assert got == {n: greedy(x) for n, x in enumerate(sets)}


def test_numbering_shares_and_counts(spark):
    row = scanned(spark, "b@x.example a@x.example b@x.example 10.1.2.3 token = \"abcd1234\"").first()
    assert [f.placeholder for f in row.findings] == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_1]", "[IP_ADDRESS_1]", "[SECRET_1]"]


def test_findings_never_overlap_and_clean_text_is_spliced(spark):
    texts = [c[1] for c in CASES] + ["", None, "é" * 50 + " a@b.example 😀 10.2.3.4", "\n".join(c[1] for c in CASES)]
    options = ScanOptions(frozenset(d.id for d in registry()))
    made = once(render.sanitize(scanned(spark, *texts, options=options)), parts=render.segments(F.coalesce("text", F.lit("")), F.col("findings"), preview=True))
    for r in made.collect():
        text, out, at = r.text or "", "", 0
        for f in r.findings:
            assert f.start >= at and text[f.start : f.end] == f.value
            out += text[at : f.start] + (f.placeholder if f.enabled else f.value)
            at = f.end
        assert r.clean_text == out + text[at:] == "".join(p.text for p in r.parts)


def test_protected_patterns_stay(spark):
    text = "$a -replace 'x@y.example', 'z'\nswitch -Regex ($b) { '10.0.0.9' { 1 } }\nb@y.example"
    assert [f.value for f in scanned(spark, text).first().findings] == ["b@y.example"]


def test_leads_are_found_but_stay(spark):
    row = render.sanitize(scanned(spark, "use Export-Clixml now")).first()
    assert [(f.value, f.enabled, f.review_lead) for f in row.findings] == [("Export-Clixml", False, True)] and row.clean_text == row.text


def test_extra_columns_pass(spark):
    df = spark.createDataFrame([(1, "a@b.example", "kept", 7)], "doc_id long, text string, findings string, start int")
    made = scan(df)
    assert made.first().start == 7 and made.first().findings[0].value == "a@b.example"
    assert scan(df.limit(0)).count() == 0


def test_settings():
    profiles = config.builtin_profiles()
    assert set(profiles) == {"balanced", "strict", "maximum", "code-secrets"}
    every = config.rule_states(profiles["maximum"])
    assert all(every.values()) and not any(on for d in registry() for i, on in config.rule_states(profiles["code-secrets"]).items() if d.id == i and d.category == "personal")
    mine = config.Profile(pack_ids=("pack-us-v1",), custom_pack_ids=("p", "q"), overrides={"us-ssn": False, "nothing": True})
    states = config.rule_states(mine, [config.CustomPack("p", ("iban", "unknown")), config.CustomPack("q", ("us-zip",), enabled=False)])
    assert states["iban"] and not states["us-ssn"] and states["us-zip"] and "unknown" not in states and "nothing" not in states
    assert config.derived_profile(config.core_states("strict")) == "strict" and config.derived_profile({}) == "custom"


@pytest.mark.parametrize(("template", "fits"), [("[{TYPE}_{INDEX}]", True), ("", False), ("x" * 41, False), ("{OTHER}", False), ("{TYPE", False), ("a$b", False), ("<{TYPE}>", True)])
def test_templates(template, fits):
    assert (render.template_problem(template) is None) == fits
    assert render.template_for("custom", template) == (template if fits else "[{TYPE}_{INDEX}]")


def test_review(spark):
    docs = scanned(spark, "a@b.example and a@b.example, 10.1.1.1; Export-Clixml")
    groups = review.ranked_groups(review.group_findings(finding_rows(docs))).orderBy("rank").collect()
    assert [(g["detector_id"], g["count"], g["enabled"]) for g in groups] == [("email", 2, True), ("ipv4", 1, True), ("credential-workflow", 1, False)]
    made = review.export_aggregates(docs).first()
    assert (made.finding_count, made.detector_count, made.replacement_count, made.kept_count, made.review_lead_count) == (4, 3, 3, 0, 1)
    assert made.counts_by_severity == {"medium": 3, "low": 1}
    switched = review.set_enabled(docs, F.array(F.lit("ipv4-2-28")), False)
    ready = review.readiness(switched).first().readiness
    assert ready.status == "review" and {i.kind for i in ready["items"]} >= {"review-leads"}


def test_files(spark, tmp_path):
    cases = {"a.txt": "plain é", "b.log": "bom", "c.json": "wide", "d.bin": "no", "e.TXT": "upper"}
    raw = {"a.txt": cases["a.txt"].encode(), "b.log": b"\xef\xbb\xbfbom", "c.json": "wide".encode("utf-16-le"), "d.bin": b"no", "e.TXT": b"upper\xff"}
    for name, content in raw.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "big.txt").write_bytes(b"x" * (files.MAX_BYTES + 1))
    got = {r.path.rsplit("/", 1)[1]: (r.problem, r.text) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (None, "plain é"), "b.log": (None, "bom"), "c.json": (None, "wide"), "d.bin": ("unsupported type", None), "e.TXT": (None, "upper�"), "big.txt": ("too large", None)}
    assert files.decode("hi".encode("utf-16")) == "hi" and files.decode(b"\xfe\xff\x00h") == "h" and files.decode(None) is None


def test_decoding_is_alike_in_both_ways(spark):
    """Native for valid UTF-8, Python for the rest: all as the function for one value has it."""
    cases = [b"", b"plain", "é😀".encode(), b"\xef\xbb\xbfmarked \xc3\xa9", b"\xef\xbb\xbfbad \xff", b"\xff\xfea\x00b\x00", b"\xfe\xff\x00a", "wide text".encode("utf-16-le"), b"a\x00b", b"bad \xc3(", b"odd\xff\xfe", b"\x10\x01" * 9, None]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, content binary").selectExpr("*", "1 as plain", "2 as rest")
    made = files.with_text(rows)
    assert made.columns == ["i", "content", "plain", "rest", "text"]
    assert {r.i: r.text for r in made.collect()} == {i: files.decode(c) for i, c in enumerate(cases)}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.example"), (2, None)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    write_sanitized(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "[EMAIL_1]", 2: ""}


def test_many_findings_are_numbered_in_order(spark):
    """More than a block of folds holds, with values that come again."""
    names = [f"u{i * 7 % 400}@x.example" for i in range(900)]
    row = render.sanitize(scanned(spark, " ".join(names))).first()
    first = {}
    wanted = [f"[EMAIL_{first.setdefault(n, len(first) + 1)}]" for n in names]
    assert [f.placeholder for f in row.findings] == wanted and row.clean_text == " ".join(wanted)


def test_folds_keep_order_over_blocks(spark):
    from inkveil.functions.spans import spans

    text = "".join(f"a{'b' * (i % 3)}-" for i in range(1000))
    got = once(spark.createDataFrame([(text,)], "t string"), s=spans(F.col("t"), "ab*")).first().s
    assert len(got) == 1000 and all(text[s.start : s.end] == s.value for s in got)


def test_word_bounds():
    from inkveil.functions.spans import BOUND, NO_WORD_BEFORE, jvm

    assert jvm(r"\b\d").startswith(NO_WORD_BEFORE) and jvm(r"\b(?:ab|[0-9]c)x").startswith(NO_WORD_BEFORE)
    for unsure in (r"\b", r"\ba?b", r"\b(?:a|-b)", r"\b[a-z-]", r"\b(?:ab)?c", r"x\b", r"\b\s"):
        assert BOUND in jvm(unsure), unsure


def test_readiness_and_summary(spark):
    docs = review.export_aggregates(review.set_enabled(scanned(spark, "a@b.example 10.1.1.1 Export-Clixml", ""), F.array(F.lit("email-0-0")), False))
    rows = review.findings_summary(review.readiness(docs, warnings=review.code_warnings(F.lit("$[X_1]")), candidates=F.lit(2), mode="portfolio-code")).collect()
    items = {i.kind: (i["count"], i.tone) for i in rows[0].readiness["items"]}
    assert items == {"kept-findings": (1, "warn"), "review-leads": (1, "info"), "candidates": (2, "info"), "code-warnings": (1, "warn")}
    assert "1 kept, and so still in the output (1 medium)" in [i.message for i in rows[0].readiness["items"]]
    assert "Findings: 3" in rows[0].summary and "  medium: 2" in rows[0].summary and "  none" in rows[1].summary and "a@b" not in rows[0].summary
    assert review.review_checklist().count("- [ ]") == 12
    sections = review.category_sections(review.group_findings(finding_rows(docs))).orderBy("section").collect()
    assert [(s.section, s.category, s.groups, s.findings) for s in sections] == [(2, "infrastructure", 1, 1), (3, "personal", 1, 1), (9, "workflow", 1, 1)]


def test_workspace():
    w = workspace.Workspace()
    pack = config.CustomPack("p1", ("iban",), name="Ours")
    applied = workspace.apply_list(workspace.apply_list(w, pack), pack)
    assert applied.active == "unsaved" and applied.profile().custom_pack_ids == ("p1",) and "iban" in applied.rules() and w.packs == ()
    saved = workspace.save_profile(applied, " Mine ", "about")
    assert saved.profile().name == "Mine" and saved.unsaved is None and config.same_config(saved.profile(), applied.profile())
    other = workspace.save_profile(workspace.select(saved, "strict"), "Other")
    changed = workspace.set_rule(other, "email", False)
    assert changed.profile().overrides == {"email": False} and changed.profiles[0] == saved.profiles[0]
    gone = workspace.delete_pack(changed, "p1")
    assert gone.packs == () and all(p.custom_pack_ids == () for p in gone.profiles)
    assert workspace.delete_profile(gone, gone.active).active == "balanced" and workspace.reset(applied).active == "balanced"
    assert workspace.rename_profile(saved, saved.active, "New").profile().name == "New" and len(workspace.duplicate_pack(saved, "p1").packs) == 2
    for bad in ("", " ", "x" * 41):
        with pytest.raises(ValueError):
            workspace.save_profile(w, bad)
    with pytest.raises(ValueError):
        workspace.select(w, "nothing")


def test_preferences(tmp_path):
    from inkveil.operators.terms import FieldRule, TermList

    path = str(tmp_path / "prefs.json")
    rule = FieldRule("r1", "Badge", ("badge",), "digits", "BADGE")
    packs = [config.CustomPack("p1", ("iban",), True, "Ours", "d", (rule,), TermList("Ours", ("secret term",), (), True, False, "HOUSE"), save) for save in (True, False)]
    for pack in packs:
        w = workspace.save_profile(workspace.apply_list(workspace.Workspace(remember=True), pack), "Mine")
        assert preferences.save(w, path) and preferences.stored(path)
        got = preferences.load(path)
        assert got.active == w.active and got.profiles[0].custom_pack_ids == ("p1",) and got.packs[0].rules == (rule,)
        assert got.packs[0].terms.values == (("secret term",) if pack.save_terms else ()) and ("secret term" in open(path).read()) == pack.save_terms
    assert not preferences.save(workspace.Workspace(), path) and not preferences.stored(path) and preferences.load(path) == workspace.Workspace()
    raw = {"version": 2, "activeProfileId": "x", "profiles": [{"id": "balanced", "name": "no"}, {"id": "a", "name": "A", "overrides": {"email": 1, "iban": True, "zz": True}, "packIds": ["pack-us-v1", "zz"]}, 5], "customPacks": [{"id": "q", "name": "Q", "terms": {"values": ["ab"]}}, {"id": ""}], "more": 1}
    made = preferences.clean(raw)
    assert made.active == "balanced" and [p.id for p in made.profiles] == ["a"] and made.profiles[0].overrides == {"iban": True} and made.profiles[0].pack_ids == ("pack-us-v1",)
    assert made.packs[0].terms.inside_words and made.packs[0].terms.values == () and preferences.clean({"version": 3}) is None and preferences.clean("no") is None
    assert preferences.migrated({"version": 1, "ruleStates": {}}).active == "balanced" and preferences.migrated({"version": 1, "ruleStates": config.core_states("strict")}).active == "strict"
    old = preferences.migrated({"version": 1, "ruleStates": {"email": False}, "format": {"id": "uniform"}})
    assert old.profile().overrides == {"email": False} and old.profile().format == "uniform"


def test_rule_catalogue_and_packages(spark, tmp_path):
    rows = config.rule_table(spark).collect()
    assert len(rows) == 49 and all(r.explanation for r in rows) and {p for r in rows for p in r.packs} == set(config.PACKS)
    docs = spark.createDataFrame([(1, "pay DE89370400440532013000, a@b.example")], SCHEMA)
    assert [f.detector_id for f in config.preview(docs, "iban").first().findings] == ["iban"]
    assert len(lists.write_package(str(tmp_path), "clean", "summary", review.review_checklist())) == 3
    made = review.suggested_entries([{"term": "ACME", "replacement": "SourceSystem", "category_label": "Organization"}, {"term": "x y", "replacement": "not usable!", "category_label": "Organization"}])
    assert [(m.term, m.strategy) for m in made] == [("ACME", "code-only")]
