"""Review analytics over findings: groups, sections, aggregates, readiness, summaries, code warnings, mapping suggestions, corpus
tallies."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import jvm, once, overlap, spans
from .scan import ScanOptions, active_detectors, chosen_rules, every_rule, find_candidates, kept_candidates
from .terms import REPLACEMENT, MappingEntry

_RANK = {"high": 3, "medium": 2, "low": 1}
MAX_WARNINGS, SNIPPET_RADIUS = 25, 30

# Patterns. The reasons are our own.
PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*(?:_\d+)?\]"
WARNINGS = (
    (rf"[pP]aram\s*\(\s*(?:\[[A-Za-z][\w.]*\]\s*)?\$?{PLACEHOLDER}", "a parameter's name is gone"),
    (rf"\b(?:[fF]unction|[fF]ilter|[wW]orkflow|[cC]lass)\s+{PLACEHOLDER}", "the name of what is declared is gone"),
    (rf"\w\.{PLACEHOLDER}", "a member's name is gone"),
    (rf"\${PLACEHOLDER}", "a variable's name is gone"),
    (rf"{PLACEHOLDER}\s+-[A-Za-z][\w-]*\b", "a command's name is gone"),
    (rf"\w{PLACEHOLDER}|{PLACEHOLDER}\w", "a part of a name is gone"),
)
ORGANIZATION_CUE = r"\b(?:health|healthcare|hospital|clinic|medical|care|group|systems?|solutions|services|technologies|software|consulting|partners|holdings|industries|enterprises|logistics|foundation|institute|university|college|academy|agency|council|authority|association|regional|centre|center|networks?|labs?|corp|corporation|inc|ltd|llc|company)\b"
#: (pattern over the trimmed term, replacement, category), the first that fits.
SHAPES = (
    (r"(?i)^(?:APP|GRP|SG|DL|ACL)-|-(?:Users|Admins|Members)\z", "App-Access-Group", "Access Group"),
    (r"(?i)^LIC-|licen[cs]e", "ProviderLicenseId", "License Group"),
    (r"(?i)(?:ticket|helpdesk|servicedesk|itsm)", "TicketingSystem", "Ticketing System"),
    (r"(?:ID|Id)\z", "SourceSystemID", "Code Identifier"),
    (r"(?i)(?:portal|console|dashboard|intranet)", "InternalApp", "Internal Application"),
    (r"(?i)\.(?:ps1|psm1|csv|json|xml|log|txt)\z", "InternalFile", "Internal File Name"),
    (r"^[A-Z]{2,6}\z", "SourceSystem", "Organization"),
    (r"(?i)^project\s|\sproject\z", "ProjectName", "Project"),
    (r"(?i)\s(?:street|avenue|ave|road|rd|drive|dr|boulevard|blvd|lane|ln|court|ct|crescent|way)\.?\z", "SourceAddress", "Address"),
    (rf"(?i)^(?=.*\s).*{ORGANIZATION_CUE}", "SourceOrg", "Organization"),
    (r"\s", "ReviewTerm", "Unclassified — edit before saving"),
)


#: The order of sections.
SECTIONS = ("secrets", "infrastructure", "personal", "paths", "organization", "code", "directory", "messaging", "workflow")

# Texts for people.
SUMMARY_COUNTS = (("Rules with findings", "detector_count"), ("Findings", "finding_count"), ("Replaced", "replacement_count"), ("Kept", "kept_count"), ("Review leads", "review_lead_count"))
SUMMARY_END = ("Only counts are given here, no text and no values.", "A scan can miss things: have a person read the cleaned file.")
CHECKLIST = (
    ("People and organizations", ("No names, initials or accounts of real people", "No names of employers, clients, teams or sites")),
    ("Infrastructure", ("No real domains, hosts or servers", "No internal addresses or network paths", "No file paths that show who uses them")),
    ("Code", ("Comments tell nothing about where it comes from", "Names of variables and functions are generic", "Sample data is made up", "No credentials of any kind")),
    ("At the end", ("The file still runs or parses", "You have read all of it", "Someone who knows the source has seen it")),
)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == k, F.lit(v)) for k, v in _RANK.items()))


def group_findings(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of finding rows, one for each rule and value of a document; enabled if all are. Attributes are those of the first."""
    first = lambda c: F.min_by(c, "pos").alias(c)
    return rows.groupBy(id_col, "detector_id", "value").agg(
        F.count(F.lit(1)).alias("count"), F.bool_and("enabled").alias("enabled"), F.bool_or("review_lead").alias("review_lead"),
        *(first(c) for c in ("name", "category", "severity", "placeholder")),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"), F.min("pos").alias("first_pos"),
    )


def ranked_groups(groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """groups with rank: by severity, name and first occurrence, for each document."""
    order = W.partitionBy(id_col).orderBy(severity_rank(F.col("severity")).desc(), "name", "first_pos")
    return groups.withColumn("rank", F.row_number().over(order))


def set_enabled(scanned: DataFrame, ids: Column, enabled: bool) -> DataFrame:
    """Findings whose id is in the array `ids` are switched."""
    return scanned.withColumn("findings", F.transform("findings", lambda f: f.withField("enabled", F.when(F.array_contains(ids, f["id"]), F.lit(enabled)).otherwise(f["enabled"]))))


def _count(findings: Column, test) -> Column:
    return F.size(F.filter(findings, test)).cast("bigint")


def _counts_by(findings: Column, name: str) -> Column:
    keys = F.array_distinct(F.transform(findings, lambda f: f[name]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _count(findings, lambda f: f[name] == k)))


def export_aggregates(scanned: DataFrame) -> DataFrame:
    """scanned with the counts of an export, row by row."""
    f = F.col("findings")
    return scanned.select(
        "*", F.size(f).cast("bigint").alias("finding_count"), F.size(F.array_distinct(F.transform(f, lambda x: x["detector_id"]))).cast("bigint").alias("detector_count"),
        _count(f, lambda x: x["enabled"] & ~x["review_lead"]).alias("replacement_count"), _count(f, lambda x: ~x["enabled"] & ~x["review_lead"]).alias("kept_count"),
        _count(f, lambda x: x["review_lead"]).alias("review_lead_count"), _counts_by(f, "category").alias("counts_by_category"), _counts_by(f, "severity").alias("counts_by_severity"),
    )


def tally(rows: DataFrame, profile: str | None = None) -> DataFrame:
    """Counts over a whole corpus by category and rule, by category, and in all: the levels have null where they sum up."""
    made = rows.rollup("category", "detector_id").agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))
    return made if profile is None else made.withColumn("profile", F.lit(profile))


def tally_profiles(df: DataFrame, profiles: Mapping[str, ScanOptions], text_col: str = "text") -> DataFrame:
    """(profile, category, detector_id, findings, documents, without_findings, unreadable): counts of a corpus under each profile by
    rule, by category (detector_id is null) and in all (category is null too); the last three counts on the rows for all.

    The text is read once, under the rules of all profiles; the profiles then share its candidates. A null text is one that could
    not be read: it is counted as such, and not among the documents."""
    known = every_rule(profiles.values())
    rules = active_detectors(known)
    masks = F.array(*(F.struct(F.lit(name).alias("profile"), F.array(*map(F.lit, chosen_rules(known, o))).alias("chosen")) for name, o in profiles.items()))
    found = find_candidates(df.select(text_col), text_col, known).select(F.col(text_col).isNull().alias("unread"), "candidates")
    one = once(found.select("unread", "candidates", F.explode(masks).alias("m")), kept=F.transform(kept_candidates(F.col("candidates"), F.col("m.chosen"), rules), lambda c: c["rule"]))
    rows = one.select("unread", F.col("m.profile").alias("profile"), F.posexplode_outer("kept").alias("pos", "rule"))
    about = lambda name: F.get(F.split(F.lit("\u0001".join(getattr(d, name) for d in rules)), "\u0001"), F.col("rule"))
    named = rows.select("unread", "profile", "pos", "rule", about("category").alias("category"), about("id").alias("detector_id"))
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    made = named.rollup("profile", "category", "detector_id").agg(
        F.count("rule").alias("findings"), F.count_if(first & ~F.col("unread")).alias("documents"), F.count_if(F.col("rule").isNull() & ~F.col("unread")).alias("without_findings"),
        F.count_if(first & F.col("unread")).alias("unreadable"), F.grouping_id().alias("level"),
    )
    shown = made.filter((F.col("level") == 3) | ((F.col("level") < 3) & F.col("category").isNotNull()))
    return shown.select("profile", "category", "detector_id", "findings", *(F.when(F.col("level") == 3, F.col(c)).alias(c) for c in ("documents", "without_findings", "unreadable")))


def scan_summary(scanned: DataFrame, rules: int) -> DataFrame:
    """One row for a corpus: documents, documents without findings, rules, findings, and replacements."""
    f = F.col("findings")
    return scanned.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.size(f) == 0).alias("documents_without_findings"), F.lit(rules).alias("rules"),
        F.coalesce(F.sum(F.size(f)), F.lit(0)).alias("findings"), F.coalesce(F.sum(_count(f, lambda x: x["enabled"])), F.lit(0)).alias("replacements"),
    )


def category_sections(groups: DataFrame, id_col: str = "doc_id", leads: bool = True) -> DataFrame:
    """(id, section, category, groups, findings): the groups of a document by category, in the order of sections; with or without
    those of review leads."""
    shown = groups if leads else groups.filter(~F.col("review_lead"))
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("category")).cast("int")
    return shown.groupBy(id_col, "category").agg(F.count(F.lit(1)).alias("groups"), F.sum("count").alias("findings")).select(id_col, section.alias("section"), "category", "groups", "findings")


def findings_summary(counted: DataFrame, mode: str = "safe-share", version: str = "1") -> DataFrame:
    """counted, from export_aggregates and readiness, with summary: a text of counts only, nothing from the source."""

    def lines(counts: str) -> Column:
        """By count, then by name."""
        rows = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key")))
        made = F.transform(F.array_sort(rows), lambda r: F.concat(F.lit("  "), r["key"], F.lit(": "), (-r["n"]).cast("string")))
        return F.when(F.size(made) == 0, F.array(F.lit("  none"))).otherwise(made)

    tone = lambda t: F.size(F.filter("readiness.items", lambda i: i["tone"] == t)).cast("string")
    line = lambda label, value: F.array(F.concat(F.lit(f"{label}: "), value.cast("string") if isinstance(value, Column) else F.lit(value)))
    text = lambda *rows: F.array(*map(F.lit, rows))
    parts = F.concat(
        text("Findings summary", "================", ""), line("Version", version), line("Output mode", mode), text(""),
        *(line(label, F.col(name)) for label, name in SUMMARY_COUNTS), text("", "By category:"), lines("counts_by_category"), text("", "By severity:"), lines("counts_by_severity"),
        text(""), line("Status", F.concat(F.col("readiness.status"), F.lit(", warnings "), tone("warn"), F.lit(", notes "), tone("info"))), text("", *SUMMARY_END, ""),
    )
    return counted.withColumn("summary", F.array_join(parts, "\n"))


def review_checklist() -> str:
    """A fixed list for a person's own review; it takes nothing from a scan."""
    sections = "\n\n".join(f"## {title}\n\n" + "\n".join(f"- [ ] {x}" for x in items) for title, items in CHECKLIST)
    return f"# Review by hand\n\nA scan is a first pass. Go through this list before you share the cleaned file.\n\n{sections}\n"


def code_warnings(text: Column) -> Column:
    """array<struct<line, snippet, reason>>: an earlier pattern claims its span; by place, at most MAX_WARNINGS by claim."""
    kind = "array<struct<start:int,end:int,reason:string>>"
    found = F.array().cast(kind)
    for pattern, reason in WARNINGS:
        found = F.concat(found, _with_reason(spans(text, pattern), reason))
    none = F.array().cast(kind)
    claimed = F.aggregate(found, none, lambda acc, s: F.when(F.exists(acc, lambda k: overlap(k, s)), acc).otherwise(F.array_append(acc, s)))
    kept = F.array_sort(F.slice(claimed, 1, MAX_WARNINGS))

    def shown(s: Column) -> Column:
        line = F.regexp_count(F.substring(text, F.lit(1), s["start"]), F.lit("\n")) + 1
        start = F.greatest(s["start"] - SNIPPET_RADIUS, F.lit(0))
        around = F.substring(text, start + 1, s["end"] + SNIPPET_RADIUS - start)
        return F.struct(line.alias("line"), F.trim(F.regexp_replace(around, r"\s+", " ")).alias("snippet"), s["reason"].alias("reason"))

    return F.transform(kept, shown)


def _with_reason(found: Column, reason: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(reason).alias("reason")))


def readiness(scanned: DataFrame, warnings: Column | None = None, candidates: Column | None = None, mode: str = "safe-share") -> DataFrame:
    """scanned with readiness: status, the open items (kind, count, message, tone), and how many findings have a replacement.

    warnings: the array of code warnings; candidates: how many suggested terms that aren't generic are open."""
    f = F.col("findings")
    kept = F.filter(f, lambda x: ~x["enabled"] & ~x["review_lead"])
    of = lambda *levels: _count(kept, lambda x: x["severity"].isin(*levels))
    breakdown = F.array_join(F.filter(F.array(*(F.when(of(s) > 0, F.concat(of(s).cast("string"), F.lit(f" {s}"))) for s in ("high", "medium"))), lambda x: x.isNotNull()), ", ")
    none, fix = F.lit(0).cast("bigint"), "use code mode with mappings" if mode == "safe-share" else "map the terms that are there"
    items = [
        ("kept-findings", of("high", "medium"), "warn", F.concat(F.lit("kept, and so still in the output ("), breakdown, F.lit(")"))),
        ("kept-findings-low", of("low"), "info", F.lit("of low severity kept, and so still in the output")),
        ("review-leads", _count(f, lambda x: x["review_lead"] & ~x["enabled"]), "info", F.lit("to check by hand; nothing is replaced")),
        ("candidates", none if candidates is None else F.coalesce(candidates, none).cast("bigint"), "info", F.lit("suggested terms to hide, map or dismiss")),
        ("code-warnings", none if warnings is None else F.size(warnings).cast("bigint"), "warn", F.lit(f"places that may no longer be valid code: {fix}")),
    ]
    every = F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("count"), F.concat_ws(" ", n.cast("string"), m).alias("message"), F.lit(t).alias("tone")) for k, n, t, m in items))
    open_ = F.filter(every, lambda i: i["count"] > 0)
    status = F.when(F.size(open_) == 0, "ready").otherwise("review")
    return scanned.withColumn("readiness", F.struct(status.alias("status"), open_.alias("items"), _count(f, lambda x: x["replacement"].isNotNull()).alias("replacement_count")))


def open_candidates(scanned: DataFrame, candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """scanned with open_candidates: how many rows of `candidates` (of the same ids) aren't generic."""
    counts = candidates.filter(~F.col("generic")).groupBy(F.col(id_col).alias("_of")).agg(F.count(F.lit(1)).alias("open_candidates"))
    joined = scanned.drop("open_candidates").join(counts, F.col(id_col).eqNullSafe(F.col("_of")), "left").drop("_of")
    return joined.withColumn("open_candidates", F.coalesce("open_candidates", F.lit(0)))


def suggest_mappings(terms: DataFrame, term_col: str = "term", order_col: str = "ord", list_col: str | None = None) -> DataFrame:
    """terms with replacement and category_label; later terms of a replacement, in each list, are numbered, before an ID suffix.
    list_col tells lists apart; without it all rows are one list, which is to be as short as a user's."""
    term = F.trim(F.col(term_col))
    pick = F.coalesce(*(F.when(term.rlike(jvm(p)), F.struct(F.lit(r).alias("replacement"), F.lit(c).alias("category_label"))) for p, r, c in SHAPES), F.struct(F.lit("SourceSystem").alias("replacement"), F.lit("Organization").alias("category_label")))
    made = terms.withColumn("s", pick).select(*terms.columns, F.when((F.col("s.replacement") == "SourceSystemID") & term.rlike(r"Id\z"), "SourceSystemId").otherwise(F.col("s.replacement")).alias("replacement"), F.col("s.category_label").alias("category_label"))
    n = F.row_number().over(W.partitionBy("replacement", *([list_col] if list_col else [])).orderBy(order_col))
    suffix = F.regexp_extract("replacement", r"(ID|Id)\z", 0)
    numbered = F.when(F.col("n") == 1, F.col("replacement")).otherwise(F.concat(F.regexp_replace("replacement", r"(?:ID|Id)\z", ""), F.col("n").cast("string"), suffix))
    return made.withColumn("n", n).withColumn("replacement", numbered).drop("n")


def suggested_entries(suggestions: Iterable) -> list[MappingEntry]:
    """Mapping entries, to be edited, from the few rows (term, replacement, category_label) that a user picked; those without a
    usable replacement are left out."""
    return [MappingEntry(r["term"], r["replacement"], r["category_label"], id=f"map-{i}") for i, r in enumerate(suggestions) if re.fullmatch(REPLACEMENT, r["replacement"])]
