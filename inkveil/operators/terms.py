"""Rules that users add: lists of terms, mapped terms, labelled fields. Small settings; each becomes native span expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.script import code_replacement
from ..functions.spans import MEDIUM, Pattern, as_spans, matches
from .detectors import Detector
from .render import placeholder_label, template_problem

MAX_TERMS, MAX_TERM_LENGTH, MIN_TERM_LENGTH = 100, 120, 2
MAX_MAPPINGS, MAX_LABELS, MAX_CAPTURE, MAX_NAME = 100, 10, 200, 40
TERM_PRIORITY, FIELD_PRIORITY = 58, 53
DEFAULT_TEMPLATE = "[{TYPE}_{INDEX}]"

# Fixed values.
MATCH_MODES = ("ci-literal", "literal", "word")
STRATEGIES = ("placeholder", "code-only", "genericize", "review-lead")
SEVERITIES = ("high", "medium", "low")
REPLACEMENT = r"[A-Za-z][A-Za-z0-9_-]{0,59}"
ENTRY_CATEGORIES = {
    "Organization": "organization", "Workflow": "workflow", "Code Identifier": "code", "Internal Application": "organization", "Access Group": "directory",
    "License Group": "directory", "Healthcare Identifier": "personal", "Ticketing System": "workflow", "Person / Initials": "personal", "Internal File Name": "paths",
    "Internal Script Name": "code", "CSV Schema / Identity Field": "workflow", "Directory Attribute": "directory", "Messaging / Exchange Workflow": "messaging",
    "Credential Workflow": "secrets", "State / Audit Artifact": "workflow", "Review Lead": "organization",
}
#: A value from its first character to its last that isn't white space.
VALUES = {"digits": r"\d(?:[\d -]*[\d-])?", "identifier": r"[A-Za-z0-9][A-Za-z0-9._-]*", "text": r"[^\r\n]*[^\s]"}


def literal(value: str) -> str:
    """value as a pattern for the JVM."""
    return re.sub(r"([^\w\s])", r"\\\1", value)


def term_pattern(term: str, case_sensitive: bool = False, inside_words: bool = False) -> str:
    """Any run of blanks, any apostrophe and any dash stand for each other."""
    alike = {" ": r"[ \t ]+", "'": r"['‘’]", "-": r"[-‐-―]"}
    parts = re.split("([ \t ]+|['‘’]|[-‐-―])", unicodedata.normalize("NFC", term))
    kinds = [" " if p[:1] in " \t " else "'" if p in "'‘’" else "-" for p in parts[1::2]]
    body = "".join(literal(word) + (alike[kind] if kind else "") for word, kind in zip(parts[::2], [*kinds, ""], strict=True))
    edges = ("", "") if inside_words else (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])")
    return ("" if case_sensitive else "(?iu)") + edges[0] + body + edges[1]


def canonical(value: Column, case_sensitive: bool = False) -> Column:
    """What spellings of one term have in common. Matches are in composed form, as the terms are."""
    same = F.translate(value, "‘’‐‑‒–—― \t", "''------  ")
    same = F.regexp_replace(same, " +", " ")
    return same if case_sensitive else F.lower(same)


@dataclass(frozen=True)
class ParsedTerms:
    """The usable terms, longest first, and the lines (from 1) of those left out, by reason."""

    terms: tuple[str, ...]
    duplicates: tuple[int, ...] = ()
    too_short: tuple[int, ...] = ()
    too_long: tuple[int, ...] = ()
    over_limit: tuple[int, ...] = ()


def analyze_terms(text: str, case_sensitive: bool = False) -> ParsedTerms:
    kept: dict[str, str] = {}
    left: dict[str, list[int]] = {k: [] for k in ("duplicates", "too_short", "too_long", "over_limit")}
    for number, term in enumerate((line.strip() for line in text.split("\n")), 1):
        key = term if case_sensitive else term.lower()
        reasons = {"too_short": len(term) < MIN_TERM_LENGTH, "too_long": len(term) > MAX_TERM_LENGTH, "duplicates": key in kept, "over_limit": len(kept) >= MAX_TERMS}
        reason = next((r for r, holds in reasons.items() if holds), None)
        if not term:
            continue
        if reason:
            left[reason].append(number)
        else:
            kept[key] = term
    return ParsedTerms(tuple(sorted(kept.values(), key=len, reverse=True)), **{k: tuple(v) for k, v in left.items()})


def _valid_template(template: str | None) -> str:
    return template if template and template_problem(template) is None else DEFAULT_TEMPLATE


def terms_detector(terms: Sequence[str], case_sensitive: bool = False, inside_words: bool = False, label: str | None = None, template: str | None = None, name: str = "Custom term to hide") -> Detector:
    """One rule for a list of terms; spellings of a term share a placeholder."""
    patterns = tuple(Pattern(term_pattern(t, case_sensitive, inside_words)) for t in terms)
    explanation = "A word or phrase from a list of terms to hide."
    return Detector("private-term", name, "personal", "high", placeholder_label(label), TERM_PRIORITY, patterns, explanation=explanation, template=_valid_template(template), normalize=lambda v: canonical(v, case_sensitive))


@dataclass(frozen=True)
class MappingEntry:
    """strategy: placeholder, in both output modes; code-only, the replacement for names in code; genericize, the replacement
    everywhere; review-lead, only flagged."""

    term: str
    replacement: str = ""
    category_label: str = "Organization"
    severity: str = "medium"
    match_mode: str = "ci-literal"
    strategy: str = "code-only"
    id: str = ""


def mapping_problem(entry: MappingEntry) -> str | None:
    term = entry.term.strip()
    needs = entry.strategy in ("code-only", "genericize")
    problems = (
        (len(term) < MIN_TERM_LENGTH, f"A term has at least {MIN_TERM_LENGTH} characters."),
        (len(term) > MAX_TERM_LENGTH, f"A term has at most {MAX_TERM_LENGTH} characters."),
        ("\n" in term or "\r" in term, "A term is on one line."),
        (bool(entry.replacement) and not re.fullmatch(REPLACEMENT, entry.replacement), "A replacement starts with a letter and has letters, digits, _ and - only."),
        (needs and not entry.replacement, "With this strategy an entry needs a replacement."),
    )
    return next((message for holds, message in problems if holds), None)


def clean_mapping(raw: object, fallback_id: str = "") -> MappingEntry | None:
    """An entry from stored data, with defaults for what is missing or unknown; None if it is still not valid."""
    if not isinstance(raw, Mapping):
        return None
    text = lambda k: raw[k] if isinstance(raw.get(k), str) else ""
    one_of = lambda k, known, default: text(k) if text(k) in known else default
    replacement = text("replacement") if re.fullmatch(REPLACEMENT, text("replacement")) else ""
    older = "code-only" if raw.get("codeSafe") is not False and replacement else "placeholder"
    made = MappingEntry(
        text("term").strip(), replacement, one_of("categoryLabel", ENTRY_CATEGORIES, "Organization"), one_of("severity", SEVERITIES, "medium"),
        one_of("matchMode", MATCH_MODES, "ci-literal"), one_of("strategy", STRATEGIES, older), text("id") if 0 < len(text("id")) <= 60 else fallback_id,
    )
    return made if mapping_problem(made) is None else None


def usable_mappings(entries: Iterable[MappingEntry]) -> list[MappingEntry]:
    """Valid entries, once for each term and match mode, longest term first."""
    kept: dict[tuple[str, str], MappingEntry] = {}
    for entry in entries:
        term = entry.term.strip()
        key = (entry.match_mode, term if entry.match_mode == "literal" else term.lower())
        if mapping_problem(entry) is None and len(kept) < MAX_MAPPINGS:
            kept.setdefault(key, MappingEntry(**{**entry.__dict__, "term": term}))
    return sorted(kept.values(), key=lambda e: len(e.term), reverse=True)


def _mapped(entry: MappingEntry, name: str, label: str, template: str) -> Detector:
    body = literal(entry.term)
    body = rf"(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_])" if entry.match_mode == "word" else body
    pattern = body if entry.match_mode == "literal" else f"(?iu){body}"

    def replacement(literals: Column, m: Column) -> Column:
        made = code_replacement(literals, m, entry.replacement)
        return F.coalesce(made, F.lit(entry.replacement)) if entry.strategy == "genericize" else made

    replaced = replacement if entry.replacement and entry.strategy in ("code-only", "genericize") else None
    mode = "lead" if entry.strategy == "review-lead" else "balanced"
    patterns = (Pattern(pattern, context=replaced is not None),)
    explanation = f"A term with an entry of its own ({entry.category_label})."
    return Detector("term-mapping", name, ENTRY_CATEGORIES.get(entry.category_label, "organization"), entry.severity, label, TERM_PRIORITY, patterns, mode, template, F.lower, replaced, explanation)


def mapping_detectors(entries: Iterable[MappingEntry], name: str = "Term mapping", label: str | None = None, template: str | None = None) -> tuple[Detector, ...]:
    """A rule for each usable entry; they share id, label and numbering."""
    return tuple(_mapped(e, name, placeholder_label(label), _valid_template(template)) for e in usable_mappings(entries))


@dataclass(frozen=True)
class FieldRule:
    """Values after one of the labels and : or =, on the same line. value_type: digits, identifier or text."""

    id: str
    name: str
    labels: tuple[str, ...]
    value_type: str = "identifier"
    placeholder_label: str = "CUSTOM_FIELD"
    category: str = "personal"
    severity: str = "medium"
    max_length: int = 80
    enabled: bool = True


def field_rule_problem(rule: FieldRule) -> str | None:
    labels = [x.strip() for x in rule.labels if x.strip()]
    problems = (
        (not rule.name.strip(), "A rule needs a name."),
        (len(rule.name) > MAX_NAME, f"The name of a rule has at most {MAX_NAME} characters."),
        (not labels, "A rule needs a label."),
        (len(labels) > MAX_LABELS, f"A rule has at most {MAX_LABELS} labels."),
        (any(len(x) > MAX_NAME for x in labels), f"A label has at most {MAX_NAME} characters."),
        (any(c in x for x in labels for c in "\r\n"), "A label is on one line."),
        (not re.fullmatch(r"[A-Z][A-Z0-9_]{0,19}", rule.placeholder_label), "A placeholder starts with a capital and has capitals, digits and _ only."),
        (not 1 <= rule.max_length <= MAX_CAPTURE, f"The longest value is from 1 to {MAX_CAPTURE} characters."),
    )
    return next((message for holds, message in problems if holds), None)


def field_pattern(rule: FieldRule) -> str:
    """Groups 1 to 3: a value within closed double or single quotes, or after none or an open one. Values that look like code
    (a variable, a call, a lone command) make no match."""
    labels = "|".join(literal(x) for x in sorted((y.strip() for y in rule.labels if y.strip()), key=len, reverse=True))
    code = r"(?![$(&`])(?![A-Za-z]+-[A-Za-z]+[ \t]*(?:[\"'\r\n]|\z))"
    if rule.value_type == "text":
        value = rf""""{code}([^"\r\n]*[^"\s])(?=[ \t]*")|'{code}([^'\r\n]*[^'\s])(?=[ \t]*')|["']?+{code}({VALUES["text"]})"""
    else:
        lone = r"(?![$(&`])(?![A-Za-z]+-[A-Za-z]+(?![A-Za-z0-9._-]))"
        value = rf"""["']?+{lone}({VALUES[rule.value_type]})"""
    return rf"(?<![A-Za-z0-9_])(?i:{labels})[ \t]*[:=][ \t]*+(?:{value})"


def _field(rule: FieldRule, fits) -> Pattern:
    groups = (1, 2, 3) if rule.value_type == "text" else (1,)
    return Pattern(field_pattern(rule), groups, lambda v: F.when(fits(F.length(v)), F.lit(MEDIUM)), gate="[:=]")


def skipped_values(rule: FieldRule, text: Column) -> Column:
    """array<SPAN>: the values that are longer than the rule's maximum; these stay as they are, whole."""
    return as_spans(matches(text, [_field(rule, lambda n: n > rule.max_length)]))


def field_detector(pack_id: str, rule: FieldRule) -> Detector:
    pattern = _field(rule, lambda n: n <= rule.max_length)
    return Detector(f"custom:{pack_id}:{rule.id}", rule.name, rule.category, rule.severity, rule.placeholder_label, FIELD_PRIORITY, (pattern,), explanation="A value after a label of your own.")


@dataclass(frozen=True)
class TermList:
    """A pack's own terms and mappings, and how they are shown."""

    name: str
    values: tuple[str, ...] = ()
    mappings: tuple[MappingEntry, ...] = field(default_factory=tuple)
    case_sensitive: bool = False
    inside_words: bool = False
    label: str | None = None
    template: str | None = None


def list_detectors(terms: TermList) -> tuple[Detector, ...]:
    parsed = analyze_terms("\n".join(terms.values), terms.case_sensitive).terms
    plain = (terms_detector(parsed, terms.case_sensitive, terms.inside_words, terms.label, terms.template, terms.name),) if parsed else ()
    return (*plain, *mapping_detectors(terms.mappings, terms.name, terms.label, terms.template))


def field_detectors(pack_id: str, rules: Iterable[FieldRule]) -> tuple[Detector, ...]:
    return tuple(field_detector(pack_id, r) for r in rules if r.enabled and field_rule_problem(r) is None)
