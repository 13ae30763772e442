"""Candidates that are kept between scans, and profiles that share them, give what scans of their own give."""

import pytest
from pyspark.sql import functions as F

from inkveil.operators import incremental as I
from inkveil.operators import review
from inkveil.operators.candidates import candidates
from inkveil.operators.scan import ScanOptions, active_detectors, scan
from inkveil.operators.terms import MappingEntry, TermList, list_detectors, terms_detector
from inkveil.plans import config

TEXTS = [
    (1, "mail bob@x.example and 10.1.2.3, Owner: Dana Whitfield\nCompany: Blue Heron Labs"), (2, "mail bob@x.example and 10.1.2.3, Owner: Dana Whitfield\nCompany: Blue Heron Labs"),
    (3, 'password = "hunter22"\nSSN 219-09-9999, call (555) 010-4477'), (4, None), (5, ""), (6, "The Zenith‐Plan and zenith plan, ZENITH  PLAN; zenithplan at 10.9.9.9"), (6, "paid 4111 1111 1111 1111 by Zenith"),
    (None, "İstanbul Zenith-plan, -match 'zenith-plan'"), (8, "nothing here"), (9, "Maſter plan"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def told(df):
    return sorted(((r.doc_id, r.text, [tuple(f) for f in r.findings]) for r in df.select("doc_id", "text", "findings").collect()), key=repr)


def stored_keys(spark, path):
    return [r.text_key for r in spark.read.parquet(f"{path}/candidates").select("text_key").collect()]


def test_every_choice_among_the_rules_from_one_store(spark, docs, tmp_path):
    known = config.options(config.Profile("strict", tuple(config.PACKS)))
    I.refresh(docs, str(tmp_path), known)
    for profile in config.builtin_profiles().values():
        options = config.options(profile)
        assert told(I.scan_stored(docs, str(tmp_path), known, options)) == told(scan(docs, options=options))
    with pytest.raises(ValueError, match="private-term"):
        I.scan_stored(docs, str(tmp_path), known, ScanOptions(extra=(terms_detector(["zenith"]),)))


def test_only_new_texts_are_read(spark, docs, tmp_path):
    known, path = ScanOptions(), str(tmp_path)
    I.refresh(docs, path, known)
    before = stored_keys(spark, path)
    assert len(before) == len(set(before)) == len({t or "" for _, t in TEXTS})
    I.refresh(docs, path, known)
    assert sorted(stored_keys(spark, path)) == sorted(before)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 8, F.lit("now from ann@y.example")).when(F.col("doc_id") == 5, F.lit("nothing here")).otherwise(F.col("text")))
    assert [r.findings for r in I.scan_stored(changed, path, known).filter("doc_id = 8").collect()] == [None]
    I.refresh(changed, path, known)
    assert len(stored_keys(spark, path)) == len(before) + 1
    fewer = config.options(config.Profile(overrides={"email": False, "ipv4": False}))
    assert told(I.scan_stored(changed, path, known, fewer)) == told(scan(changed, options=fewer))
    assert told(I.scan_stored(docs, path, known)) == told(scan(docs))
    assert told(I.scan_stored(docs.limit(0), path, known)) == []
    versioned = docs.withColumn("version", F.coalesce("text", F.lit("-")))
    I.refresh(versioned, f"{path}/v", known, key=F.col("version"))
    assert told(I.scan_stored(versioned, f"{path}/v", known, key=F.col("version"))) == told(scan(docs))


def test_fingerprints_follow_what_the_rules_do():
    base = ScanOptions(extra=(terms_detector(["zenith"]),))
    assert I.rules_fingerprint(base) == I.rules_fingerprint(ScanOptions(extra=(terms_detector(["zenith"], label="OTHER"),)))
    others = [ScanOptions(), ScanOptions(frozenset(["email"])), ScanOptions(extra=(terms_detector(["zeniths"]),)), ScanOptions(extra=(terms_detector(["zenith"], case_sensitive=True),))]
    assert len({I.rules_fingerprint(o) for o in (base, *others)}) == 5


@pytest.mark.parametrize("terms", [TermList("t", ("zenith plan",)), TermList("t", ("Zenith-Plan", "master")), TermList("t", ("istanbul", "absent word")), TermList("t", ("enith",), inside_words=True), TermList("t", ("--",)), TermList("t", (), (MappingEntry("zenith", "Plan", strategy="genericize", match_mode="word"),))])
def test_hiding_one_more_term(spark, docs, tmp_path, terms):
    known, path = ScanOptions(), str(tmp_path)
    I.refresh(docs, path, known)
    I.index_words(docs, path)
    full = ScanOptions(extra=list_detectors(terms))
    assert told(I.scan_hiding(docs, path, known, terms)) == told(scan(docs, options=full))


def test_the_index_finds_few(spark, docs, tmp_path):
    I.index_words(docs, str(tmp_path))
    I.index_words(docs, str(tmp_path))
    texts = {r.text_key: r.text for r in docs.select(I.text_key().alias("text_key"), "text").collect()}
    found = lambda *terms: {texts[r.text_key] for r in I.texts_with(spark, str(tmp_path), terms).collect()}
    assert found("ZENITH plan") == {TEXTS[5][1], TEXTS[7][1]} and found("master") == {TEXTS[9][1]}
    assert found("zenith", "nothing") == {TEXTS[5][1], TEXTS[6][1], TEXTS[7][1], TEXTS[8][1]} and found("absent") == set()
    assert I.texts_with(spark, str(tmp_path), ["--"]) is None


def test_profiles_share_one_scan(spark, docs):
    profiles = {name: config.options(p) for name, p in config.builtin_profiles().items()} | {"terms": ScanOptions(extra=(terms_detector(["zenith"]),))}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in review.tally_profiles(docs, profiles).collect()}
    want = {}
    for name, options in profiles.items():
        rows = [r.findings for r in scan(docs.filter("text IS NOT NULL"), options=options).collect()]
        for f in (f for fs in rows for f in fs):
            for key in ((name, f.category, f.detector_id), (name, f.category, None)):
                want[key] = (want.get(key, (0,))[0] + 1, None, None, None)
        want[name, None, None] = (sum(map(len, rows)), len(rows), sum(not fs for fs in rows), 1)
    assert got == want
    assert review.tally_profiles(docs.limit(0), profiles).collect() == []


def test_one_pass_of_patterns_for_all_profiles(spark, docs):
    """The plan has each pattern's matches once, whatever the number of profiles."""
    plan = lambda names: review.tally_profiles(docs, {n: config.options(p) for n, p in config.builtin_profiles().items() if n in names})._jdf.queryExecution().optimizedPlan().toString()
    one, four = (plan(names).count("regexp_extract_all") for names in (["maximum"], list(config.builtin_profiles())))
    assert four == one > 0


def test_dismissed_terms_from_a_table(spark):
    docs = spark.createDataFrame([(1, "Blue Heron saw QZX. Blue Heron and QZX and Grey Owl.")], "doc_id long, text string")
    scanned = scan(docs)
    terms = lambda **more: {r.text for r in candidates(scanned, **more).collect()}
    assert terms() == {"Blue Heron", "QZX", "Grey Owl"}
    gone = spark.createDataFrame([("blue \t heron",), ("Qzx",), ("never",)], "term string")
    assert terms(dismissed=gone) == terms(dismissed=["Blue Heron", "QZX"]) == {"Grey Owl"}
    assert active_detectors(ScanOptions())
