"""From findings to text: splicing, output modes, masks, segments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import fold, let, once

# Fixed values.
PRESETS = {"indexed": "[{TYPE}_{INDEX}]", "unnumbered": "[{TYPE}]", "uniform": "[REDACTED]"}
TEMPLATE_CHARACTERS = r"[A-Za-z0-9 _\-\[\]{}()<>#:.]*"
DOT = "•"


def _spliced(text: Column, found: Column, between: Callable[[Column], Column], shown: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind>: `between` of the text outside the spans, and `shown` of each span and its own text; both give arrays. A span that
    starts before the last one's end is skipped. What is left of the text is cut once a block, so the work grows with the text."""

    def cut(done: Column, start: Column, end: Column) -> Column:
        return F.substring(done["rest"], start - done["base"] + 1, end - start)

    def step(done: Column, f: Column) -> tuple[dict[str, Column], Column]:
        skip = f["start"] < done["at"]
        made = F.concat(between(cut(done, done["at"], f["start"])), shown(f, cut(done, f["start"], f["end"])))
        return {"at": F.when(skip, done["at"]).otherwise(f["end"])}, F.when(skip, F.array().cast(f"array<{kind}>")).otherwise(made)

    def at_block(done: Column, _: Column) -> dict[str, Column]:
        return {"base": done["at"], "rest": F.substring(done["rest"], done["at"] - done["base"] + 1, F.length(done["rest"]))}

    folded = fold(found, {"at": F.lit(0), "base": F.lit(0), "rest": text}, step, kind, at_block)
    return let(folded, lambda d: F.concat(d["out"], between(F.substring(d["rest"], d["at"] - d["base"] + 1, F.length(d["rest"])))))


def clean_text(text: Column, findings: Column) -> Column:
    """text with the placeholders of enabled findings; one that starts before the last one's end is skipped."""
    active = F.array_sort(F.transform(F.filter(findings, lambda f: f["enabled"]), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["placeholder"].alias("placeholder"))))
    return F.when(F.size(findings) == 0, text).otherwise(F.array_join(_spliced(text, active, F.array, lambda f, _: F.array(f["placeholder"]), "string"), ""))


def with_field(f: Column, **values: Column) -> Column:
    for name, value in values.items():
        f = f.withField(name, value)
    return f


def apply_mode(findings: Column, mode: str) -> Column:
    """In mode "portfolio-code" a finding's replacement, if it has one, takes its placeholder's place."""
    if mode != "portfolio-code":
        return findings
    return F.transform(findings, lambda f: with_field(f, placeholder=F.coalesce(f["replacement"], f["placeholder"])))


def sanitize(scanned: DataFrame, text_col: str = "text", mode: str = "safe-share") -> DataFrame:
    """scanned with clean_text."""
    return scanned.withColumn("clean_text", clean_text(F.coalesce(F.col(text_col), F.lit("")), apply_mode(F.col("findings"), mode)))


def compare_modes(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """scanned with safe_share, portfolio_code and changed_lines. The text is made once where no finding has a replacement."""
    of = lambda mode: clean_text(F.coalesce(F.col(text_col), F.lit("")), apply_mode(F.col("findings"), mode))
    both = once(scanned.drop("safe_share", "portfolio_code"), safe_share=of("safe-share"))
    both = once(both, portfolio_code=F.when(F.exists("findings", lambda f: f["replacement"].isNotNull()), of("portfolio-code")).otherwise(F.col("safe_share")))
    lines = F.zip_with(F.split("safe_share", "\n", -1), F.split("portfolio_code", "\n", -1), lambda a, b: ~a.eqNullSafe(b))
    return both.withColumn("changed_lines", F.when(F.col("safe_share") == F.col("portfolio_code"), 0).otherwise(F.size(F.filter(lines, lambda x: x))))


def mask(value: Column) -> Column:
    n = F.length(value)
    tail = F.when(n > 14, F.right(value, F.lit(2))).otherwise(F.lit(""))
    return F.when(n <= 6, F.concat(F.left(value, F.lit(1)), F.lit(DOT * 4))).otherwise(F.concat(F.left(value, F.lit(4)), F.lit(DOT * 8), tail))


def segments(text: Column, findings: Column, preview: bool = False) -> Column:
    """array<struct<text, kind, category, enabled>>: the source with its matches, or the output with its placeholders."""
    kind = "array<struct<text:string,kind:string,category:string,enabled:boolean>>"
    plain = lambda t: F.struct(t.alias("text"), F.lit("plain").alias("kind"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("boolean").alias("enabled"))
    some = lambda t: F.when(F.length(t) > 0, F.array(plain(t))).otherwise(F.array().cast(kind))

    def shown(f: Column, own: Column) -> Column:
        if preview:
            placed = F.struct(f["placeholder"].alias("text"), F.lit("placeholder").alias("kind"), f["category"].alias("category"), F.lit(None).cast("boolean").alias("enabled"))
            return F.array(F.when(f["enabled"], placed).otherwise(plain(own)))
        return F.array(F.struct(own.alias("text"), F.lit("match").alias("kind"), f["category"].alias("category"), f["enabled"].alias("enabled")))

    return _spliced(text, findings, some, shown, kind[6:-1])


def line_pieces(found: Column) -> Column:
    """array<struct<line, segment, text, kind>>: segments cut at line ends, each piece with its line from 0; empty ones are left out."""
    items = F.transform(found, lambda s, i: F.struct(i.alias("segment"), F.split(s["text"], "\n", -1).alias("pieces"), s["kind"].alias("kind")))

    def step(d: Column, x: Column) -> tuple[dict[str, Column], Column]:
        made = F.transform(x["pieces"], lambda p, n: F.struct((d["line"] + n).alias("line"), x["segment"].alias("segment"), p.alias("text"), x["kind"].alias("kind")))
        return {"line": d["line"] + F.size(x["pieces"]) - 1}, F.filter(made, lambda p: p["text"] != "")

    return fold(items, {"line": F.lit(0)}, step, "struct<line:int,segment:int,text:string,kind:string>")["out"]


def segment_rows(df: DataFrame, segments_col: str, id_col: str = "doc_id") -> DataFrame:
    """A row for each piece of a line: line (from 0), segment, text, kind. Empty pieces are left out. Each row of df is handled alone, so
    ids may repeat."""
    return df.select(id_col, F.explode(line_pieces(F.col(segments_col))).alias("p")).select(id_col, "p.*")


def template_problem(template: str) -> str | None:
    """What is wrong with a placeholder template, or None."""
    if not template:
        return "A template is needed."
    if len(template) > 40:
        return "A template has at most 40 characters."
    if not re.fullmatch(TEMPLATE_CHARACTERS, template):
        return "A template has a character that it may not have."
    tokens = re.findall(r"\{([^{}]*)\}", template)
    if set(tokens) - {"TYPE", "INDEX"}:
        return "In braces there can be TYPE or INDEX only."
    if re.search(r"[{}]", re.sub(r"\{[^{}]*\}", "", template)):
        return "A brace has no other end."
    return None


def template_for(format_id: str, custom: str = "") -> str:
    if format_id == "custom":
        return custom if template_problem(custom) is None else PRESETS["indexed"]
    return PRESETS.get(format_id, PRESETS["indexed"])


def placeholder_label(value: object, fallback: str = "CUSTOM_TERM") -> str:
    made = value.strip().upper()[:20] if isinstance(value, str) else ""
    return made if re.fullmatch(r"[A-Z][A-Z0-9_]{0,19}", made) else fallback
