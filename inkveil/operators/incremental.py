"""Candidates kept between scans, so that a scan reads only texts that are new, whatever rules are chosen, and a new term's documents only.

A store is a folder of Parquet files that are only added to. What the rules match in a text depends on the text and on the rules' own
definitions, so that is its key: the text's hash and a fingerprint of the rules. A changed document is a new text; one that comes back,
or a copy, is known. Choosing among the rules changes no candidates. A failed write adds nothing, and two writers at once add equal rows,
of which one counts.

Beside it, an index of words tells which texts have all words of a term. Hiding one more term so costs the scan of those texts for that
term; the others keep what is stored.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import PROTECTED, ScanOptions, active_detectors, find_candidates, resolve_candidates
from .terms import TermList, list_detectors

#: Parts of the index of words; one is read for each word that is sought.
WORD_PARTS = 256


def _told(value: object) -> str:
    """value in words that are equal in every session if it does the same."""
    if dataclasses.is_dataclass(value):
        return f"{type(value).__name__}({','.join(f'{f.name}={_told(getattr(value, f.name))}' for f in dataclasses.fields(value))})"
    if isinstance(value, (tuple, list)):
        return f"[{','.join(map(_told, value))}]"
    if isinstance(value, (set, frozenset)):
        return f"{{{','.join(sorted(map(_told, value)))}}}"
    if isinstance(value, functools.partial):
        return f"{_told(value.func)}({_told(value.args)},{_told(sorted(value.keywords.items()))})"
    if callable(value) and hasattr(value, "__code__"):
        code, cells = value.__code__, [c.cell_contents for c in value.__closure__ or ()]
        consts = [c for c in code.co_consts if not hasattr(c, "co_code")]
        return f"{value.__module__}.{value.__qualname__}:{code.co_code.hex()}:{_told(consts)}:{_told(code.co_names)}:{_told(value.__defaults__ or ())}:{_told(cells)}"
    return repr(value)


def rules_fingerprint(options: ScanOptions) -> str:
    """Of the definitions of the active rules; names, templates and what else only shows later don't count."""
    shown = {"name": "", "explanation": "", "template": None, "label": "", "category": "", "severity": ""}
    rules = [dataclasses.replace(d, **shown) for d in active_detectors(options)]
    return hashlib.sha256(_told([rules, PROTECTED]).encode()).hexdigest()[:32]


def text_key(text_col: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _new_texts(docs: DataFrame, path: str, text_col: str, key: Column | None, rules: str | None) -> DataFrame:
    """(text_key, text), once each, of the texts that the table at path hasn't. Only keys are compared; texts move if they are new."""
    keyed = docs.select((text_key(text_col) if key is None else key).alias("text_key"), F.col(text_col).alias("text"))
    if _exists(docs.sparkSession, path):
        known = docs.sparkSession.read.parquet(path)
        known = known.filter(F.col("rules") == rules) if rules else known
        stale = keyed.select("text_key").distinct().join(known.select("text_key"), "text_key", "left_anti")
        keyed = keyed.join(stale, "text_key", "left_semi")
    return keyed.dropDuplicates(["text_key"])


def refresh(docs: DataFrame, path: str, known: ScanOptions, text_col: str = "text", key: Column | None = None) -> None:
    """Adds to the store at path the candidates of texts that it hasn't for the rules of `known`. key: what tells texts apart, as a
    version would; by default their hash. A null text is an empty one."""
    rules = rules_fingerprint(known)
    new = _new_texts(docs, f"{path}/candidates", text_col, key, rules)
    found = find_candidates(new, "text", known).select(F.lit(rules).alias("rules"), "text_key", "candidates", "literals")
    found.write.mode("append").partitionBy("rules").parquet(f"{path}/candidates")


def _stored(docs: DataFrame, path: str, known: ScanOptions, text_col: str, key: Column | None) -> DataFrame:
    """docs with the store's text_key, candidates and literals."""
    store = docs.sparkSession.read.parquet(f"{path}/candidates").filter(F.col("rules") == rules_fingerprint(known)).drop("rules")
    keyed = docs.withColumn("text_key", text_key(text_col) if key is None else key)
    return keyed.join(store.dropDuplicates(["text_key"]), "text_key", "left")


def scan_stored(docs: DataFrame, path: str, known: ScanOptions, options: ScanOptions | None = None, text_col: str = "text", key: Column | None = None) -> DataFrame:
    """docs with the findings of a scan under `options` (by default `known`), whose rules are among those of `known`, from the store. A
    text that it hasn't, as it wasn't refreshed, has null findings."""
    met = _stored(docs, path, known, text_col, key)
    there = F.col("candidates").isNotNull().alias("_there")
    made = resolve_candidates(met.select("*", there), known, options or known)
    return made.withColumn("findings", F.when(F.col("_there"), F.col("findings"))).drop("text_key", "_there")


def _folded(text: Column) -> Column:
    return F.upper(F.lower(F.translate(text, "\u0130", "i")))


def index_words(docs: DataFrame, path: str, text_col: str = "text", key: Column | None = None) -> None:
    """Adds to the index at path the words of texts that it hasn't: a row for each word of a text, by the word's hash. Words are runs of
    letters and digits, in any case alike; the rows of a frequent word are split."""
    new = _new_texts(docs, f"{path}/indexed", text_col, key, None)
    words = F.array_distinct(F.filter(F.split(_folded(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    rows = new.select("text_key", F.explode(words).alias("w")).select(F.xxhash64("w").alias("word"), "text_key")
    rows = rows.withColumn("part", F.pmod("word", F.lit(WORD_PARTS)).cast("int"))
    rows.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(f"{path}/words")
    new.select("text_key").write.mode("append").parquet(f"{path}/indexed")


def texts_with(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame | None:
    """(text_key) of the texts that have all words of one of the terms; None if a term has no word, which any text may have."""
    made = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "term int, t string")
    words = F.array_distinct(F.filter(F.split(_folded(F.col("t")), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    sought = made.select("term", F.explode(words).alias("w")).select("term", F.xxhash64("w").alias("word")).collect()
    if {r.term for r in sought} != set(range(len(terms))):
        return None
    index = spark.read.parquet(f"{path}/words").filter(F.col("part").isin(sorted({r.word % WORD_PARTS for r in sought})))
    asked = spark.createDataFrame([(r.term, r.word) for r in sought], "term int, w bigint")
    needed = asked.groupBy("term").agg(F.count(F.lit(1)).alias("needed"))
    met = index.join(F.broadcast(asked), F.col("word") == F.col("w")).select("term", "word", "text_key").distinct()
    return met.groupBy("term", "text_key").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(needed), "term").filter("n = needed").select("text_key").distinct()


def scan_hiding(docs: DataFrame, path: str, known: ScanOptions, terms: TermList, text_col: str = "text", key: Column | None = None) -> DataFrame:
    """docs with the findings of a scan under `known` and a list of terms after its rules: what is stored, and of the texts that have a
    term's words, what the terms match. Lists that match inside words may match in any text."""
    spark, rules = docs.sparkSession, list_detectors(terms)
    everywhere = terms.inside_words or any(m.match_mode != "word" for m in terms.mappings)
    touched = None if everywhere else texts_with(spark, path, [*terms.values, *(m.term for m in terms.mappings)])
    texts = docs.select((text_key(text_col) if key is None else key).alias("text_key"), F.col(text_col).alias("text"))
    texts = (texts if touched is None else texts.join(touched, "text_key", "left_semi")).dropDuplicates(["text_key"])
    before = len(active_detectors(known))
    own = F.transform(F.filter("candidates", lambda c: c["rule"] >= 0), lambda c: c.withField("rule", c["rule"] + before))
    more = find_candidates(texts, "text", ScanOptions(frozenset(), rules)).select(F.col("text_key").alias("_key"), own.alias("_more"), F.col("literals").alias("_literals"))
    both = _stored(docs, path, known, text_col, key).join(more, F.col("text_key") == F.col("_key"), "left")
    literals = F.when(F.size("literals") == 0, F.coalesce("_literals", "literals")).otherwise(F.col("literals"))
    both = both.withColumns({"candidates": F.concat("candidates", F.coalesce("_more", F.slice("candidates", 1, 0))), "literals": literals}).drop("_key", "_more", "_literals")
    extended = ScanOptions(frozenset(d.id for d in active_detectors(known)[: before - len(known.extra)]), (*known.extra, *rules), known.template)
    return resolve_candidates(both, extended, extended).drop("text_key")


__all__ = ["index_words", "refresh", "rules_fingerprint", "scan_hiding", "scan_stored", "texts_with"]
