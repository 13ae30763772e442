"""Rules in Python beside the native ones: their spans take part in the same resolution, and SQL can call them as a table function.

A rule's function sees one text and gives the spans that it finds, in code points. All such rules run in one Arrow pass over the texts;
the native rules stay native, and nothing is shuffled, so streams are scanned in the same way. Matches of Python rules count as of high
confidence; by that, their priority and their length they keep or lose their place among the native ones.

Defined cases: a null or empty text isn't shown to the rules; spans that a rule gives twice count once; a span outside its text, or an empty
one, is an error that names the rule; very long texts are shown whole; rows may repeat; no rules at all leave a plain scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import AFTER, BEFORE
from .detectors import Detector, registry
from .scan import GIVEN, ScanOptions, scan

_MATCHES = "array<struct<key:int,start:int,end:int,value:string,before:string,after:string>>"
_ARROW = pa.list_(pa.struct([("key", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("before", pa.string()), ("after", pa.string())]))


@dataclass(frozen=True)
class PythonRule:
    """find: of a text, the (start, end) of what is to be found, the end exclusive. It runs in Python workers, so it must be picklable."""

    id: str
    name: str
    label: str
    find: Callable[[str], Iterable[tuple[int, int]]]
    category: str = "custom"
    severity: str = "medium"
    priority: int = 50
    mode: str = "balanced"
    explanation: str = ""

    def detector(self, number: int) -> Detector:
        return Detector(self.id, self.name, self.category, self.severity, self.label, self.priority, (), self.mode, explanation=self.explanation, given=number)


def rules_problem(rules: Sequence[PythonRule]) -> str | None:
    """What is wrong with the ids of rules, or None: each is its own, and none is that of a native rule."""
    ids = [r.id for r in rules]
    taken = {d.id for d in registry()} & set(ids)
    if taken:
        return f"A native rule has this id: {min(taken)}"
    return next((f"Two rules have this id: {i}" for i in ids if ids.count(i) > 1), None)


def _spans(rule: PythonRule, text: str) -> list[tuple[int, int]]:
    found = sorted(set(rule.find(text)))
    for start, end in found:
        if not 0 <= start < end <= len(text):
            raise ValueError(f"rule {rule.id}: no span of the text: {start} to {end}, of {len(text)}")
    return found


def _checked(rules: Sequence[PythonRule]) -> list[PythonRule]:
    problem = rules_problem(rules)
    if problem:
        raise ValueError(problem)
    return list(rules)


def python_matches(text: Column, rules: Sequence[PythonRule]) -> Column:
    """array<struct<key, start, end, value, before, after>>, by rule and place; key is the rule's number in `rules`."""
    rules = _checked(rules)

    def one(t: str) -> list[dict]:
        return [
            {"key": i, "start": s, "end": e, "value": t[s:e], "before": t[max(0, s - BEFORE) : s], "after": t[e : e + AFTER]}
            for i, rule in enumerate(rules) for s, e in _spans(rule, t)
        ]

    @F.arrow_udf(_MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) if t else [] for t in texts.to_pylist()], _ARROW)

    return found(text)


def scan_python(df: DataFrame, rules: Sequence[PythonRule], options: ScanOptions | None = None, text_col: str = "text") -> DataFrame:
    """What scan gives under `options` with Python rules after its own."""
    options = options or ScanOptions()
    if not rules:
        return scan(df, text_col, options)
    added = ScanOptions(options.enabled, (*options.extra, *(r.detector(i) for i, r in enumerate(rules))), options.template)
    return scan(df.withColumn(GIVEN, python_matches(F.col(text_col), rules)), text_col, added).drop(GIVEN)


def register_rules(spark: SparkSession, name: str, rules: Sequence[PythonRule]) -> None:
    """A table function for SQL: name(text) has a row (rule, start, end, value) for each span, by rule and place, before any resolution.

    It is to be joined laterally: SELECT d.doc_id, m.* FROM documents d, LATERAL name(d.text) m."""
    rules = _checked(rules)

    class Matches:
        def eval(self, text: str):
            for rule in rules if text else ():
                for start, end in _spans(rule, text):
                    yield rule.id, start, end, text[start:end]

    spark.udtf.register(name, F.udtf(Matches, returnType="rule string, start int, end int, value string", useArrow=True))


__all__ = ["PythonRule", "python_matches", "register_rules", "rules_problem", "scan_python"]
