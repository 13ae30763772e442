"""Files of term lists, plain or JSON, and exports. Small files of settings, read and written by the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.render import placeholder_label, template_for, template_problem
from ..operators.terms import MAX_MAPPINGS, MAX_NAME, MAX_TERM_LENGTH, MAX_TERMS, MIN_TERM_LENGTH, FieldRule, MappingEntry, TermList, clean_mapping

LIST_KIND, LIST_VERSION = "inkveil.term-list", 1
MAX_LIST_BYTES = 256 * 1024
# Fixed values.
#: Names of what a user may export, and of the files of a whole package.
EXPORT_NAMES = ("clean-text.txt", "findings-summary.txt", "review-checklist.md", "sanitized.ps1")
PACKAGE_NAMES = ("sanitized.ps1", "findings-summary.txt", "review-checklist.md")
_KEYS = {"id": "id", "term": "term", "replacement": "replacement", "category_label": "categoryLabel", "severity": "severity", "match_mode": "matchMode", "strategy": "strategy"}


@dataclass(frozen=True)
class ParsedList:
    terms: tuple[str, ...]
    added: int = 0
    empty: int = 0
    duplicate: int = 0
    too_long: int = 0
    capped: bool = False


def parse_lines(text: str, existing: Sequence[str] = (), case_sensitive: bool = False) -> ParsedList:
    """The existing terms and those of the lines, up to the limit of a list, with counts of what was left out."""
    key = (lambda t: t) if case_sensitive else str.lower
    terms, seen = list(existing), {key(t) for t in existing}
    left = {"empty": 0, "duplicate": 0, "too_long": 0}
    for term in (line.strip() for line in text.replace("\r\n", "\n").split("\n")):
        reason = "empty" if not term else "too_long" if len(term) > MAX_TERM_LENGTH else "duplicate" if key(term) in seen else None
        if reason:
            left[reason] += 1
        elif len(terms) >= MAX_TERMS:
            return ParsedList(tuple(terms), len(terms) - len(existing), **left, capped=True)
        else:
            terms.append(term)
            seen.add(key(term))
    return ParsedList(tuple(terms), len(terms) - len(existing), **left)


def import_summary(parsed: ParsedList) -> str:
    """One line on what parse_lines took: empty lines aren't worth a word, and no term is repeated in it."""
    skipped = parsed.duplicate + parsed.too_long
    parts = [f"{parsed.added} term{'' if parsed.added == 1 else 's'} added"]
    parts += [f"{skipped} left out"] if skipped else []
    parts += [f"the list is full at {MAX_TERMS}"] if parsed.capped else []
    return f"{'; '.join(parts)}. The terms are not stored unless you say so."


def list_problem(terms: Sequence[str], new: bool = True) -> str | None:
    """Why a list of terms can't be saved, or None. Only a new one needs a term: an older one may be emptied."""
    usable = any(MIN_TERM_LENGTH <= len(t.strip()) <= MAX_TERM_LENGTH for t in terms)
    return "A new list needs at least one usable term." if new and not usable else None


def pack_problem(detector_ids: Sequence[str], rules: Sequence[FieldRule]) -> str | None:
    """Why a pack can't be saved, or None. With neither rules nor labelled fields it would be a list of terms."""
    return None if detector_ids or rules else "A pack needs a rule or a labelled field; terms alone make a list."


def _stored(entry: MappingEntry) -> dict:
    return {name: getattr(entry, own) for own, name in _KEYS.items()} | {"codeSafe": entry.strategy in ("code-only", "genericize")}


def dump_list(terms: TermList) -> str:
    made = {"kind": LIST_KIND, "version": LIST_VERSION, "name": terms.name, "caseSensitive": terms.case_sensitive, "matchInsideWords": terms.inside_words}
    made |= {k: v for k, v in (("termLabel", terms.label), ("termTemplate", terms.template)) if v}
    return json.dumps(made | {"terms": list(terms.values), "mappings": [_stored(m) for m in terms.mappings]}, indent=2, ensure_ascii=False) + "\n"


def load_list(text: str) -> TermList:
    """A list from JSON; ValueError says what is wrong. Unknown fields are ignored, unusable terms and mappings left out."""
    if len(text.encode()) > MAX_LIST_BYTES:
        raise ValueError("The file is too large.")
    try:
        data = json.loads(text)
    except ValueError:
        raise ValueError("Not a valid JSON file.") from None
    if not isinstance(data, dict) or data.get("kind") != LIST_KIND:
        raise ValueError("Not a term list file.")
    if data.get("version") != LIST_VERSION:
        raise ValueError("This version of term list files is not supported.")
    name = data["name"].strip()[:MAX_NAME] if isinstance(data.get("name"), str) else ""
    if not name:
        raise ValueError("The file has no usable list name.")
    listed = lambda k: data[k] if isinstance(data.get(k), list) else []
    terms = [t.strip() for t in listed("terms") if isinstance(t, str) and MIN_TERM_LENGTH <= len(t.strip()) <= MAX_TERM_LENGTH][:MAX_TERMS]
    mappings = [m for m in (clean_mapping(raw, f"map-{i}") for i, raw in enumerate(listed("mappings"))) if m][:MAX_MAPPINGS]
    if not terms and not mappings:
        raise ValueError("The file contains no usable terms or mappings.")
    label = placeholder_label(data["termLabel"]) if isinstance(data.get("termLabel"), str) else None
    template = data.get("termTemplate") if isinstance(data.get("termTemplate"), str) and template_problem(data["termTemplate"]) is None else None
    return TermList(name, tuple(terms), tuple(mappings), data.get("caseSensitive") is True, data.get("matchInsideWords") is True, label, template and template_for("custom", template))


def write_export(path: str, name: str, text: str) -> str:
    """One document's text under an allowed name, byte for byte."""
    if name not in EXPORT_NAMES:
        raise ValueError(f"not an export: {name}")
    with open(f"{path.rstrip('/')}/{name}", "w", encoding="utf-8", newline="") as file:
        file.write(text)
    return file.name


def write_package(path: str, clean: str, summary: str, checklist: str) -> list[str]:
    """One document's package: cleaned text, summary and checklist."""
    return [write_export(path, name, text) for name, text in zip(PACKAGE_NAMES, (clean, summary, checklist), strict=True)]


def write_clean(sanitized: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The texts of a corpus as Parquet, with their ids."""
    sanitized.select(id_col, "clean_text").write.mode("errorifexists").parquet(path)
