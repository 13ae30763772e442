"""Matches of patterns with their places, as native array expressions.

Spark has functions for all matches and for what lies between them, but none for places. A match starts after all text between
earlier matches and all earlier matches, so one fold over both gives every place. The fold is written once and serves all patterns
of a scan: each pattern only adds the arrays of its matches, and only to texts that pass its gate and have a match. Places count code
points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,confidence:int>"
#: A match with the number of its pattern and, if the pattern asks for them, what surrounds it and a further group.
MATCH = "struct<p:int,start:int,end:int,value:string,before:string,after:string,extra:string,confidence:int>"
#: What hits_sql gives for a pattern.
HIT = "struct<p:int,at:int,g:array<string>,m:array<string>,v:array<string>,x:array<string>,c:boolean>"
#: What scripting engines count as white space, for use in a character class.
BLANKS = r"\s\x0B   -     　﻿"
#: A word bound that knows ASCII letters only, whatever the JVM's version.
BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same where a letter, digit or _ follows for sure, which is cheaper.
NO_WORD_BEFORE = "(?<![A-Za-z0-9_])"
HIGH, MEDIUM, LOW = 3, 2, 1
#: How many characters before and after a match its pattern's test sees.
BEFORE, AFTER = 128, 16
#: Folds append within blocks of so many elements, so that what is copied grows with the elements and not with their square.
BLOCK = 256
#: In SQL, a character that stands for matches while a text is cut at them; texts that have it are cut by the pattern.
MARK = r"'\u0001'"


def jvm(pattern: str) -> str:
    """pattern, written for an engine whose word bounds are ASCII and whose white space is Unicode, for the JVM."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(NO_WORD_BEFORE if _word_first(pattern, i + 2) else BOUND)
        elif two == r"\s":
            out.append(BLANKS if inside else f"[{BLANKS}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{BLANKS}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (inside or two[0] == "[") and not (inside and two[0] == "]")
            out.append("\\[" if inside and two[0] == "[" and out and _open(out) else two[0])
            i -= 1
        i += 2
    return "".join(out)


def _open(out: list[str]) -> bool:
    """Whether a class is open already, so that a further bracket is a character of it."""
    depth = 0
    for piece in out:
        if piece == "[":
            depth += 1
        elif piece == "]" and depth:
            depth -= 1
    return depth > 0


def _word_first(pattern: str, i: int) -> bool:
    """Whether whatever matches from place i of the pattern starts with a word character. False if that isn't plain to see."""
    if pattern.startswith(("(?:", "(?i:"), i) or (pattern[i : i + 1] == "(" and pattern[i + 1 : i + 2] != "?"):
        start = pattern.index(":", i) + 1 if pattern[i + 1] == "?" else i + 1
        depth, at = 0, start
        starts = [start]
        while depth >= 0 and at < len(pattern):
            c = pattern[at]
            if c == "\\":
                at += 1
            elif c == "[":
                at = pattern.index("]", at + 2)
            else:
                depth += (c == "(") - (c == ")")
                if c == "|" and depth == 0:
                    starts.append(at + 1)
            at += 1
        return pattern[at : at + 1] not in ("?", "*", "{") and all(_word_first(pattern, s) for s in starts)
    item = re.match(r"\\d|\[(?:\w-\w|\w)+\]|\w", pattern[i:], re.ASCII)
    return bool(item) and pattern[i + item.end() : i + item.end() + 1] not in ("?", "*", "|", ")") and not pattern.startswith("{0", i + item.end())


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that no later expression or lambda computes again: each comes out of a generator, which only passes on what a
    projection has made, as that runs as generated code."""
    for name, value in columns.items():
        made = f"{name}_made"
        df = df.select("*", value.alias(made)).select("*", F.explode(F.array(made)).alias(name)).drop(made)
    return df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once. A fold over nothing; an element of an array would have its type derived for every row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda same, _: same, use)


def mapped(items: Column, function: str) -> Column:
    """The array with a function in SQL applied to each element."""
    return F.call_function("transform", items, F.expr(function))


def fold(items: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], nothing: str | Column, at_block: Callable[[Column, Column], dict[str, Column]] | None = None) -> Column:
    """struct of the state after all items, and `out`, an array of what came out. nothing: the type of one such, or an empty array.

    step gets the state and an item, and gives the fields that change and an array of what comes out. at_block gives fields that
    change before each block, of the state and the block's items. Linear in the items, as long as the state's fields are small."""
    nothing = F.array().cast(f"array<{nothing}>") if isinstance(nothing, str) else nothing

    def state(of: Callable[[str], Column], out: Column) -> Column:
        return F.struct(*(of(n).alias(n) for n in start), out.alias("out"))

    def one(done: Column, item: Column) -> Column:
        changed, out = step(done, item)
        return state(lambda n: changed.get(n, done[n]), F.concat(done["out"], out))

    def block(done: Column, part: Column) -> Column:
        begun = at_block(done, part) if at_block else {}
        inner = F.aggregate(part, state(lambda n: begun.get(n, done[n]), nothing), one)
        return let(inner, lambda made: state(lambda n: made[n], F.array_append(done["out"], made["out"])))

    last = lambda every: F.call_function("div", F.greatest(F.size(every) - 1, F.lit(0)), F.lit(BLOCK)).cast("int")
    blocks = let(items, lambda every: F.transform(F.sequence(F.lit(0), last(every)), lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK))))
    zero = state(lambda n: start[n], F.slice(F.array(nothing), 1, 0))
    return F.aggregate(blocks, zero, block, lambda done: state(lambda n: done[n], F.flatten(done["out"])))


def bound(value: str, name: str, use: str) -> str:
    """SQL: use, in which name stands for value, computed once."""
    return f"aggregate(cast(array() AS array<int>), {value}, (same, none) -> same, {name} -> {use})"


def fold_sql(items: str, start: dict[str, str], changes: dict[str, str], out: str, nothing: str) -> str:
    """fold in SQL, of a variable with an array: changes and out are of the state d and an item x; nothing is an empty array."""
    state = lambda of, out: f"named_struct({', '.join(f'{n!r}, {of(n)}' for n in start)}, 'out', {out})"
    step = f"(d, x) -> {state(lambda n: changes.get(n, f'd.{n}'), f'concat(d.out, {out})')}"
    inner = f"aggregate(part, {state(lambda n: f'done.{n}', nothing)}, {step})"
    block = f"(done, part) -> {bound(inner, 'made', state(lambda n: f'made.{n}', 'array_append(done.out, made.out)'))}"
    blocks = f"transform(sequence(0, cast(greatest(size({items}) - 1, 0) div {BLOCK} AS int)), b -> slice({items}, b * {BLOCK} + 1, {BLOCK}))"
    return f"aggregate({blocks}, {state(lambda n: start[n], f'slice(array({nothing}), 1, 0)')}, {block}, done -> {state(lambda n: f'done.{n}', 'flatten(done.out)')})"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


@dataclass(frozen=True)
class Pattern:
    """What is sought, and what a match must fulfil.

    groups: the value is the first of these that isn't empty, at its last place within the match.
    gate: literals of which a text must have one, in any case; or a pattern that it must match; cheaper than the pattern itself.
    confidence: a rank, or a function of the value; matches for which it is null are left out.
    test: a function of the match, with before, after and extra.
    cut: gives another value, that starts at the same place, from the match.
    extra: a further group.
    has: literals that a text must have all of.
    number: whether every match has a digit, 0 to 9.
    context: whether before and after are wanted though there is neither test nor cut.
    within: the pattern is sought in the matches of another one only, in each on its own.
    lines: a match, what decides it and its gate are in one line, up to a line feed: only lines that pass the gate are searched.
    starts: literals of which the line where a match starts has one, in any case: lines before the first such aren't searched. Such a
    match may run on over lines; its test and cut see nothing before the line."""

    regex: str
    groups: tuple[int, ...] = (0,)
    confidence: int | Callable[[Column], Column] = HIGH
    gate: tuple[str, ...] | str = ()
    test: Callable[[Column], Column] | None = None
    cut: Callable[[Column], Column] | None = None
    extra: int | None = None
    within: Pattern | None = None
    has: tuple[str, ...] = ()
    number: bool = False
    context: bool = False
    lines: bool = False
    starts: tuple[str, ...] = ()


def _raw(pattern: str) -> str:
    """A string literal of SQL, in which backslashes are plain; quotes and what looks like a variable of SQL are written by number."""
    made = re.sub(r"\\(.)|'", lambda m: r"\x27" if m[0] in ("'", "\\'") else m[0], pattern, flags=re.DOTALL)
    return "r'" + made.replace("${", r"$\x7B") + "'"


#: Of a struct t with a text and the same in lower case, t and l: its lines, with where they start. Lower case keeps line feeds.
_LINES = bound(
    "zip_with(split(v.t, '\\n', -1), split(v.l, '\\n', -1), (t, l) -> named_struct('t', t, 'l', l))", "every",
    fold_sql("every", {"at": "0"}, {"at": "d.at + length(x.t) + 1"}, "array(named_struct('at', d.at, 't', x.t, 'l', x.l))", "cast(array() AS array<struct<at:int,t:string,l:string>>)") + ".out",
)


LINES = f"if(contains(v.t, '\\n'), {_LINES}, array(named_struct('at', 0, 't', v.t, 'l', v.l)))"


def lines_of(text: Column, low: Column) -> Column:
    return F.get(mapped(F.array(F.struct(text.alias("t"), low.alias("l"))), f"v -> {LINES}"), F.lit(0))


def hits_sql(text: str, low: str, digit: str, patterns: Sequence[Pattern], lines: str | None = None, gates: str | None = None, numbers: Sequence[int] | None = None) -> str:
    """SQL for an array with the arrays of each pattern that isn't sought within others; nulls for those without matches.

    low: the text in lower case; digit: whether it has one; lines: those of lines_of, without which whole texts are searched. gates: an
    array of gates_sql, which are looked at again otherwise. Patterns that seek the same in whole texts share one search. numbers: those
    of with_contexts that are sought at all, of which gates has one each."""
    whole, parts, alike = [], [], {}
    every = with_contexts(patterns)
    for place, i in enumerate(range(len(every)) if numbers is None else numbers):
        p = every[i]
        if p.within:
            continue
        gate = f"get({gates}, {place})" if gates else _gate_sql(text, low, digit, p)
        if lines and by_line(p):
            near = f"if(size({lines}) = 1, {lines}, filter({lines}, y -> {_gate_sql('y.t', 'y.l', None, p)}))"
            parts.append(f"CASE WHEN {gate} THEN transform({near}, y -> {_hit_sql('y.t', i, p, 'y.at')}) END")
        elif lines and p.starts:
            first = f"get(filter({lines}, y -> {' OR '.join(f'contains(y.l, {_raw(g)})' for g in p.starts)}), 0).at"
            parts.append(f"CASE WHEN {gate} THEN transform(array({first}), y -> {bound(f'substring({text}, y + 1)', 'rest', _hit_sql('rest', i, p, 'y'))}) END")
        else:
            alike.setdefault((p.regex, p.groups, p.extra), []).append((i, p, gate))
    for (i, p, gate), *more in alike.values():
        if more:
            same = [(i, p, gate), *more]
            fields = ", ".join(f"'{n}', h.{n}" for n in ("at", "g", "m", "v", "x"))
            one = lambda i, p, gate: f"CASE WHEN h IS NOT NULL AND {gate} THEN named_struct('p', {i}, {fields}, 'c', {_near_sql(p)}) END"
            parts.append(f"CASE WHEN {' OR '.join(dict.fromkeys(f'({g})' for _, _, g in same))} THEN {bound(_hit_sql(text, i, p, '0'), 'h', f'array({", ".join(one(*e) for e in same)})')} END")
        else:
            whole.append(f"CASE WHEN {gate} THEN {_hit_sql(text, i, p, '0')} END")
    made = f"array({', '.join(whole)})"
    if not parts:
        return made
    return f"flatten(array_compact(array({', '.join([made, *parts] if whole else parts)})))"


def by_line(p: Pattern) -> bool:
    return p.lines and bool(p.gate or p.has)


def gates_sql(text: str, low: str, digit: str, some: str | None, patterns: Sequence[Pattern], numbers: Sequence[int] | None = None) -> str:
    """SQL for an array: of each pattern, with those of with_contexts, whether it is sought in the text.

    some: whether the text has one of gate_literals. numbers: those that are asked for, if not all."""

    def one(p: Pattern) -> str:
        if p.within:
            return "false"
        return f"{f'{some} AND ' if some and _listed(p) else ''}{_gate_sql(text, low, digit, p)}"

    every = with_contexts(patterns)
    return f"array({', '.join(map(one, every if numbers is None else [every[i] for i in numbers]))})"


def _listed(p: Pattern) -> bool:
    """Whether the pattern's gate is one of literals alone that are no mere signs."""
    return isinstance(p.gate, tuple) and bool(p.gate) and not p.number and not p.within and min(map(len, p.gate)) > 2


def gate_literals(patterns: Sequence[Pattern]) -> list[str]:
    """The literals of the gates of patterns that need one, in small letters, without those that another one is a part of."""
    every = {g for p in with_contexts(patterns) if _listed(p) for g in p.gate}
    return sorted(x for x in every if not any(y != x and y in x for y in every))


#: About how often letters and signs are met among 1,000 characters of prose; others are rarer.
_OFTEN = dict(zip("etaoinsrhldcumfpgwybvkxjqz", (100, 75, 65, 60, 58, 57, 53, 50, 45, 35, 32, 24, 24, 21, 18, 16, 16, 15, 14, 12, 8, 6, 2, 1, 1, 1), strict=True)) | {" ": 180, ".": 10, ",": 10, "-": 3}


def any_literal(literals: Sequence[str]) -> str:
    """A pattern for one of the literals that is cheaper than looking for each: it stops only at a few characters, rare ones, of which
    every literal has one, and there looks back and ahead."""
    quoted = lambda x: re.sub("[^A-Za-z0-9 ]", r"\\\g<0>", x)
    left, stops = list(literals), {}
    while left:
        stop = min({c for x in left for c in x}, key=lambda c: (_OFTEN.get(c, 1) / sum(c in x for x in left), c))
        stops[stop] = [f"(?<={quoted(x[: x.index(stop) + 1])}){quoted(x[x.index(stop) + 1 :])}" for x in left if stop in x]
        left = [x for x in left if stop not in x]
    return f"(?=[{''.join(map(quoted, stops))}])(?:{'|'.join(f'{quoted(c)}(?:{chr(124).join(around)})' for c, around in stops.items())})"


def with_contexts(patterns: Sequence[Pattern]) -> list[Pattern]:
    """The patterns, and after them those that they are sought within."""
    return [*patterns, *{id(p.within): p.within for p in patterns if p.within}.values()]


def _gate_sql(text: str, low: str | None, digit: str | None, p: Pattern) -> str:
    """SQL for whether the text passes the pattern's gate."""
    some = "true"
    if isinstance(p.gate, str):
        some = f"rlike({text}, {_raw(jvm(p.gate))})"
    elif p.gate and low:
        some = f"({' OR '.join(f'contains({low}, {_raw(g)})' for g in p.gate)})"
    for literal in reversed(p.has):
        some = f"contains({text}, {_raw(literal)}) AND {some}"
    return f"{digit} AND {some}" if p.number and digit else some


def _hit_sql(text: str, number: int, p: Pattern, at: str) -> str:
    """SQL for the arrays of the pattern's matches; null where there are none. One text parses faster than its pieces are built."""
    pattern = _raw(jvm(p.regex))
    group = lambda g: f"regexp_extract_all({text}, {pattern}, {g})"
    value = "cast(null AS array<string>)" if p.groups == (0,) else group(p.groups[0])
    for g in p.groups[1:]:
        value = f"zip_with({value}, {group(g)}, (a, b) -> if(length(a) > 0, a, b))"
    extra = "cast(null AS array<string>)" if p.extra is None else group(p.extra)
    # Cutting by a pattern makes it anew for every text, replacing by one doesn't.
    gaps = f"if(contains({text}, {MARK}), split({text}, {pattern}, -1), split(regexp_replace({text}, {pattern}, {MARK}), {MARK}, -1))"
    made = f"named_struct('p', {number}, 'at', {at}, 'g', {gaps}, 'm', m, 'v', {value}, 'x', {extra}, 'c', {_near_sql(p)})"
    return bound(group(0), "m", f"CASE WHEN size(m) > 0 THEN {made} END")


def _near_sql(p: Pattern) -> str:
    """Whether the pattern asks for what is around its matches."""
    return "true" if p.context or p.test is not None or p.cut is not None else "false"


#: Of a hit h and the number i of a match: where its value starts within it.
_INNER = "coalesce(length(get(h.m, i)) - instr(reverse(get(h.m, i)), reverse(get(h.v, i))) - length(get(h.v, i)) + 1, 0)"
#: The same: its lengths, and what is around it.
_PART = f"""named_struct(
  'gap', length(get(h.g, i)), 'tail', if(h.c, right(get(h.g, i), {BEFORE}), ''), 'm', get(h.m, i), 'n', length(get(h.m, i)), 'v', coalesce(get(h.v, i), get(h.m, i)),
  'inner', {_INNER}, 'size', length(coalesce(get(h.v, i), get(h.m, i))),
  'after', if(h.c, left(concat(coalesce(get(h.g, i + 1), ''), coalesce(get(h.m, i + 1), '')), {AFTER}), ''), 'x', get(h.x, i))"""
_NEAR = f"if(h.c, right(concat(d.before, q.tail), {BEFORE}), '')"
#: Of the state d and a part q: the state after it, which has the match with its place.
_STEP = f"""named_struct(
  'at', d.at + q.gap + q.n, 'before', if(h.c, right(concat({_NEAR}, q.m), {BEFORE}), ''),
  'out', array_append(d.out, named_struct(
    'p', h.p, 'start', d.at + q.gap + q.inner, 'end', d.at + q.gap + q.inner + q.size, 'value', q.v, 'before', {_NEAR}, 'after', q.after, 'extra', q.x, 'confidence', cast(null AS int))))"""
#: The only match of a hit.
_ONE = bound(f"h.at + length(get(h.g, 0)) + {_INNER.replace(', i)', ', 0)')}", "start", bound("coalesce(get(h.v, 0), get(h.m, 0))", "v", f"""array(named_struct(
  'p', h.p, 'start', start, 'end', start + length(v), 'value', v, 'before', if(h.c, right(get(h.g, 0), {BEFORE}), ''), 'after', if(h.c, left(get(h.g, 1), {AFTER}), ''),
  'extra', get(h.x, 0), 'confidence', cast(null AS int)))"""))  # fmt: skip
#: All matches of a hit: a fold over blocks of matches, and in each over its matches.
_PLACES = f"""h -> if(size(h.m) = 1, {_ONE}, aggregate(
  transform(sequence(0, cast((size(h.m) - 1) div {BLOCK} AS int)), b -> transform(sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK} - 1, size(h.m) - 1)), i -> {_PART})),
  named_struct('at', h.at, 'before', '', 'out', cast(array() AS array<array<{MATCH}>>)),
  (done, part) -> get(transform(
    array(aggregate(part, named_struct('at', done.at, 'before', done.before, 'out', cast(array() AS array<{MATCH}>)), (d, q) -> {_STEP})),
    r -> named_struct('at', r.at, 'before', r.before, 'out', array_append(done.out, r.out))), 0),
  done -> flatten(done.out)))"""


def _placed(hits: Column) -> Column:
    """array<MATCH>, not yet ranked, of hits."""
    return F.flatten(mapped(hits, _PLACES))


def _case(m: Column, choices: Sequence[tuple[object, int, Column]], otherwise: Column) -> Column:
    """The value for the match's pattern; patterns with the same key share one."""
    shared: dict[object, tuple[list[int], Column]] = {}
    for key, number, value in choices:
        shared.setdefault(key, ([], value))[0].append(number)
    made = None
    for numbers, value in shared.values():
        here = m["p"] == numbers[0] if len(numbers) == 1 else m["p"].isin(*numbers)
        made = F.when(here, value) if made is None else made.when(here, value)
    return otherwise if made is None else made.otherwise(otherwise)


_FIELDS = ("p", "start", "end", "value", "before", "after", "extra", "confidence")


def _with(m: Column, **changed: Column) -> Column:
    return F.struct(*(changed[n].alias(n) if n in changed else m[n].alias(n) for n in _FIELDS))


def _cut(found: Column, patterns: Sequence[Pattern], nested: bool) -> Column:
    """found, with values cut, of the patterns that are or aren't sought within others."""
    cuts = [(i, p.cut) for i, p in enumerate(patterns) if p.cut and bool(p.within) == nested]
    if not cuts:
        return found
    cut = lambda m: let(_case(m, [(cut, i, cut(m)) for i, cut in cuts], m["value"]), lambda v: _with(m, value=v, end=m["start"] + F.length(v)))
    return F.transform(found, lambda m: F.when(m["p"].isin(*(i for i, _ in cuts)), cut(m)).otherwise(m))


def _ranked(found: Column, patterns: Sequence[Pattern]) -> Column:
    """found, with confidences; without what fails."""

    def rank(m: Column) -> Column:
        choices = []
        for i, p in enumerate(patterns):
            if callable(p.confidence) or p.test:
                value = p.confidence(m["value"]) if callable(p.confidence) else F.lit(p.confidence)
                choices.append(((p.confidence, p.test), i, (F.when(p.test(m), value) if p.test else value).cast("int")))
        plain = F.expr(f"array({','.join('null' if callable(p.confidence) else str(p.confidence) for p in patterns)})").cast("array<int>")
        return _case(m, choices, F.get(plain, m["p"]))

    ranked = F.transform(found, lambda m: _with(m, confidence=rank(m)))
    return F.filter(ranked, lambda m: (F.length(m["value"]) > 0) & m["confidence"].isNotNull())


def matches(text: Column, patterns: Sequence[Pattern]) -> Column:
    """array<MATCH> of all patterns; see matches_of."""
    if not patterns:
        return F.array().cast(f"array<{MATCH}>")
    # SQL text can name its own variables only.
    known = F.array(F.struct(text.alias("t"), F.lower(text).alias("l"), text.rlike("[0-9]").alias("d")))
    return matches_of(F.get(mapped(known, f"e -> {hits_sql('e.t', 'e.l', 'e.d', patterns)}"), F.lit(0)), patterns)


def matches_of(hits: Column, patterns: Sequence[Pattern]) -> Column:
    """array<MATCH> from hits_sql, by pattern and place; patterns that are sought within others come last."""
    every = with_contexts(patterns)
    contexts = every[len(patterns) :]
    found = _cut(_placed(F.array_compact(hits)), every, False)
    if not contexts:
        return _ranked(found, every)
    first = len(patterns)
    tests = [(c.test, first + j, c) for j, c in enumerate(contexts) if c.test]

    def joined(all_: Column) -> Column:
        whole = F.filter(all_, lambda m: (m["p"] >= first) & _case(m, [(t, i, t(m)) for t, i, _ in tests], F.lit(True)))
        cases = []
        for j, context in enumerate(contexts):
            here = ", ".join(f"CASE WHEN {_gate_sql('c.value', None, None, p)} THEN {_hit_sql('c.value', i, p, 'c.start')} END" for i, p in enumerate(patterns) if p.within is context)
            cases.append(f"WHEN c.p = {first + j} THEN array({here})")
        hits = F.array_compact(F.flatten(mapped(whole, f"c -> CASE {' '.join(cases)} END")))
        inner = _cut(_placed(hits), patterns, True)
        return F.concat(F.filter(all_, lambda m: m["p"] < first), inner)

    return _ranked(let(found, lambda all_: F.when(F.exists(all_, lambda m: m["p"] >= first), joined(all_)).otherwise(all_)), patterns)


def as_spans(found: Column) -> Column:
    """array<SPAN>, by place, of matches."""
    return F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["confidence"].alias("confidence"))))


def spans(text: Column, pattern: str, groups: tuple[int, ...] = (0,), confidence: int | Callable[[Column], Column] = HIGH) -> Column:
    """array<SPAN> of one pattern."""
    return as_spans(matches(text, [Pattern(pattern, groups, confidence)]))


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
