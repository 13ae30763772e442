"""Places of scripts that rules and replacements must know, as native expressions: string literals, patterns of regex switches,
identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import Pattern, as_spans, jvm, matches, spans

#: A comment (no group), or the inside of a literal; one that isn't closed runs to the end of the text.
LITERALS = r"""(?=[#'"])(?:#[^\n]*|'([^']*+(?:''[^']*+)*+)(?:'|\z)|"([^"`]*+(?:`[\s\S]?[^"`]*+)*+)(?:"|\z))"""
QUOTED = r"""('(?:[^'\r\n]|'')*+'|"(?:`.|[^"\r\n])*")"""
SWITCH = r"(?i:\bswitch\s+-Regex\b)[^{\r\n]*\{"
#: A piece of a script up to a brace outside literals, or to the end of a literal.
PIECE = r"""[^{}'"]*+(?:[{}]|'[^']*+(?:''[^']*+)*+(?:'|\z)|"[^"`]*+(?:`[\s\S]?[^"`]*+)*+(?:"|\z))"""


def _block(m: Column) -> Column:
    """The match and what follows up to its brace's end, or to the end of the text."""
    pieces = F.regexp_extract_all(m["extra"], F.lit(jvm(PIECE)), F.lit(0))

    def step(done: Column, piece: Column) -> Column:
        brace = F.regexp_extract(piece, r"""^[^{}'"]*([{}])\z""", 1)
        depth = done["depth"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        at = done["at"] + F.length(piece)
        return F.struct(at.alias("at"), depth.alias("depth"), F.coalesce(done["end"], F.when(depth == 0, at)).alias("end"))

    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("depth"), F.lit(None).cast("int").alias("end"))
    end = F.aggregate(pieces, start, step)["end"]
    return F.concat(m["value"], F.substring(m["extra"], F.lit(1), F.coalesce(end, F.length(m["extra"]))))


_SWITCH_BLOCK = Pattern(rf"{SWITCH}(?=([\s\S]*))", gate=("switch",), extra=1, cut=_block)
#: The quoted cases of every `switch -Regex` block, up to its closing brace or the end of the text.
SWITCH_CASES = Pattern(rf"(?:(?m:^)|\A{SWITCH})\s*{QUOTED}\s*\{{", (1,), within=_SWITCH_BLOCK)


def string_literals(text: Column) -> Column:
    """array<SPAN>: the insides of string literals; quotes in comments open none."""
    return spans(text, LITERALS, (1, 2))


def switch_patterns(text: Column) -> Column:
    """array<SPAN> of SWITCH_CASES."""
    return as_spans(matches(text, [SWITCH_CASES]))


def is_identifier(m: Column) -> Column:
    """Whether a match is (part of) a name in code: within a word, a variable, a member, half of Verb-Noun, or being declared."""
    one, pair = F.right(m["before"], F.lit(1)), F.right(m["before"], F.lit(2))
    two = F.when(F.length(pair) == 2, F.left(pair, F.lit(1))).otherwise(F.lit(""))
    next_, second = F.left(m["after"], F.lit(1)), F.substring(m["after"], 2, 1)
    line = F.regexp_extract(m["before"], r"[^\n]*\z", 0)
    declared = line.rlike(jvm(r"(?i)(?:function|filter|workflow|class)\s+\z"))
    inside = F.concat(one, next_).rlike("[A-Za-z0-9_]")
    member = (one == ".") & two.rlike(r"[A-Za-z0-9_)\]]")
    command = ((one == "-") & two.rlike("[A-Za-z0-9_]")) | ((next_ == "-") & second.rlike("[A-Za-z0-9_]"))
    return inside | (one == "$") | member | command | declared


def adapted_case(matched: Column, replacement: str, one: Column, next_: Column) -> Column:
    """replacement in the manner of what it replaces: a word of capitals that stands alone makes it UPPER_SNAKE, a small first
    letter makes its own small."""
    letters = F.regexp_replace(matched, "[^A-Za-z]", "")
    snake = F.upper(F.regexp_replace(F.lit(replacement), "([a-z0-9])([A-Z])", "$1_$2"))
    capitals = (F.length(letters) >= 2) & (letters == F.upper(letters))
    alone = ~F.concat(one, next_).rlike("[A-Za-z]")
    small = F.lit(replacement[:1].lower() + replacement[1:])
    return F.when(capitals, F.when(alone, snake).otherwise(F.lit(replacement))).when(letters.rlike("^[a-z]"), small).otherwise(F.lit(replacement))


def code_replacement(literals: Column, m: Column, replacement: str) -> Column:
    """The adapted replacement where a match is a name in code outside string literals, else null."""
    quoted = F.exists(literals, lambda r: (m["start"] >= r["start"]) & (m["end"] <= r["end"]))
    made = adapted_case(m["value"], replacement, F.right(m["before"], F.lit(1)), F.left(m["after"], F.lit(1)))
    return F.when(~quoted & is_identifier(m), made)
