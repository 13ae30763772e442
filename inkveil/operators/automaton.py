"""Lists of terms and mappings of any length in one pass: an automaton over the folded text, with places back in the source.

As patterns, every term is a pass of its own over each text. Here the text is folded once for each kind of list (case; blanks, dashes and
apostrophes that stand for each other) and an automaton of all terms goes over it, so the time grows with the text and the matches,
not with the terms. What it finds are candidates like any other rule's: the same places, the same resolution.

The pass is an Arrow UDF over the text column alone, for Spark has no function for many terms at once; all other rules stay native.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from collections.abc import Sequence
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import AFTER, BEFORE
from .detectors import Detector
from .scan import GIVEN, ScanOptions, scan
from .terms import TermList, analyze_terms, list_detectors, usable_mappings

_BLANKS, _ALIKE = " \t ", {**dict.fromkeys("‘’", "'"), **{chr(c): "-" for c in range(0x2010, 0x2016)}}
_RUN = re.compile(f"[{_BLANKS}]+")
_ARROW = pa.list_(pa.struct([("key", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]))


class Needle(NamedTuple):
    """A term. key: its rule's number; fold: whether case doesn't count; alike: whether blanks, dashes and apostrophes stand for each
    other; edges: characters beside letters and digits that may not be next to it, None if any may."""

    text: str
    key: int
    fold: bool
    alike: bool
    edges: str | None


@cache
def _small(c: str) -> str:
    """c in the form in which characters of either case are one character."""
    if c == "İ":
        return "i"
    upper = c.upper() if len(c.upper()) == 1 else c
    return upper.lower() if len(upper.lower()) == 1 else upper


def _plain(text: str, fold: bool, alike: bool) -> str:
    """text in one form, character by character; runs of blanks are still runs."""
    made = "".join(_small(c) for c in text) if fold else text
    return "".join(_ALIKE.get(c, " " if c in _BLANKS else c) for c in made) if alike else made


def folded(text: str, fold: bool, alike: bool) -> tuple[str, list[int] | None]:
    """text in one form, and where each of its characters starts in the source; None if that is its own place."""
    made = _plain(text, fold, alike)
    if not alike or "  " not in made:
        return made, None
    places = [i for i, c in enumerate(made) if c != " " or i == 0 or made[i - 1] != " "]
    return re.sub(" +", " ", made), [*places, len(text)]


def _word(c: str, edges: str) -> bool:
    return unicodedata.category(c)[0] in "LN" or c in edges


class Terms:
    """Finds needles in texts."""

    def __init__(self, needles: Sequence[Needle]):
        self.needles = needles
        self.kinds: dict[tuple[bool, bool], ahocorasick.Automaton] = {}
        by_kind: dict[tuple[bool, bool], dict[str, list[int]]] = {}
        for i, n in enumerate(needles):
            by_kind.setdefault((n.fold, n.alike), {}).setdefault(folded(n.text, n.fold, n.alike)[0], []).append(i)
        for kind, words in by_kind.items():
            found = self.kinds[kind] = ahocorasick.Automaton()
            for word, own in words.items():
                found.add_word(word, (len(word), own))
            found.make_automaton()

    def matches(self, text: str) -> list[dict]:
        """Of each needle the matches from the left that don't overlap, by needle and place."""
        out: dict[int, list[tuple[int, int]]] = {}
        for kind, automaton in self.kinds.items():
            made, places = folded(text, *kind)
            for last, (length, own) in automaton.iter(made):
                start, end = last + 1 - length, last + 1
                if places:
                    start, end = places[start], places[end]
                for i in own:
                    edges = self.needles[i].edges
                    if edges is not None and (start and _word(text[start - 1], edges) or end < len(text) and _word(text[end], edges)):
                        continue
                    mine = out.setdefault(i, [])
                    if not mine or start >= mine[-1][1]:
                        mine.append((start, end))
        return [
            {"key": self.needles[i].key, "start": s, "end": e, "value": text[s:e], "before": text[max(0, s - BEFORE) : s], "after": text[e : e + AFTER]}
            for i in sorted(out) for s, e in out[i]
        ]


def needles(terms: TermList) -> list[Needle]:
    """The needles of list_detectors(terms), in its order of rules."""
    parsed = analyze_terms("\n".join(terms.values), terms.case_sensitive).terms
    made = [Needle(unicodedata.normalize("NFC", t), 0, not terms.case_sensitive, True, None if terms.inside_words else "") for t in parsed]
    first = int(bool(parsed))
    modes = {"literal": (False, None), "ci-literal": (True, None), "word": (True, "_")}
    return made + [Needle(e.term, first + i, modes[e.match_mode][0], False, modes[e.match_mode][1]) for i, e in enumerate(usable_mappings(terms.mappings))]


def term_matches(text: Column, sought: Sequence[Needle]) -> Column:
    """array<struct<key, start, end, value, before, after>> of a text; none for null. A task makes the automaton once."""
    made: list[Terms] = []

    @F.arrow_udf("array<struct<key:int,start:int,end:int,value:string,before:string,after:string>>")
    def found(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Terms(sought))
        return pa.array([made[0].matches(t) if t else [] for t in texts.to_pylist()], _ARROW)

    return found(text)


def given_detectors(terms: TermList) -> tuple[Detector, ...]:
    """The rules of a list, which take their matches from a column instead of seeking patterns."""
    return tuple(dataclasses.replace(d, patterns=(), given=i) for i, d in enumerate(list_detectors(terms)))


def scan_terms(df: DataFrame, terms: TermList, options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
    """What scan gives under `options` with the rules of a list after its own; the list may be long."""
    options = options or ScanOptions()
    added = ScanOptions(options.enabled, (*options.extra, *given_detectors(terms)), options.template)
    sought = needles(terms)
    if not sought:
        return scan(df, text_col, options)
    return scan(df.withColumn(GIVEN, term_matches(F.col(text_col), sought)), text_col, added).drop(GIVEN)


__all__ = ["given_detectors", "needles", "scan_terms", "term_matches"]
