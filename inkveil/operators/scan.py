"""Scanning: matches of the active rules, protected ranges, greedy resolution, numbering, findings.

One pass over each document and no shuffle: everything of a document is in arrays of its row, so the same transform serves
batches and streams. Text columns stay as they are; offsets count code points. All steps after the matches sort and fold, so their
work grows with the matches (n log n); among those that overlap each other without a break, kept ones are looked up by place.

A scan has two halves that can also be had apart: `find_candidates` reads the text, `resolve_candidates` needs it no more. So candidates
of many rules, found once, serve every choice among those rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.script import QUOTED, SWITCH_CASES, string_literals
from ..functions.spans import HIGH, HIT, MATCH, Pattern, any_literal, as_spans, bound, by_line, fold_sql, gate_literals, gates_sql, hits_sql, let, lines_of, mapped, matches, matches_of, no_spans, once, overlap, with_contexts
from .detectors import Detector, registry

DEFAULT_TEMPLATE = "[{TYPE}_{INDEX}]"
#: The column with matches that are made before the scan: structs with the rule's number (key), start, end, value, before and after.
GIVEN = "_given_matches"

# Strings that hold search patterns of a script, and so stay untouched.
PROTECTED = (
    Pattern(rf"(?i)(?:-replace|-match|-notmatch)\s+{QUOTED}", (1,), gate=("-replace", "-match", "-notmatch")),
    Pattern(rf"(?i)\bSelect-String\b[^\r\n;|]*?-Pattern\s+{QUOTED}", (1,), gate=("select-string",)),
    Pattern(rf"(?i)\[regex\]::(?:Match|Matches|Replace)\s*\(\s*[^,\r\n]+,\s*{QUOTED}", (1,), gate=("[regex]::",)),
    SWITCH_CASES,
)


@dataclass(frozen=True)
class ScanOptions:
    """enabled: ids of rules to run, in registry order; None for all that are on by default. extra: further rules."""

    enabled: frozenset[str] | None = None
    extra: tuple[Detector, ...] = field(default_factory=tuple)
    template: str = DEFAULT_TEMPLATE


def active_detectors(options: ScanOptions) -> list[Detector]:
    rules = registry()
    if options.enabled is None:
        chosen = [d for d in rules if not d.strict_only and not d.pack_only]
    else:
        chosen = [d for d in rules if d.id in options.enabled]
    return [*chosen, *options.extra]


def protected_ranges(text: Column) -> Column:
    return F.array_distinct(as_spans(matches(text, PROTECTED)))


def render(template: Column | str, label: Column, index: Column) -> Column:
    template = F.lit(template) if isinstance(template, str) else template
    return F.replace(F.replace(template, F.lit("{TYPE}"), label), F.lit("{INDEX}"), index.cast("string"))


@dataclass(frozen=True)
class _Plan:
    """The patterns of all rules, protected ones last, and the rule of each number; special functions have numbers after those."""

    rules: Sequence[Detector]
    patterns: tuple[Pattern, ...]
    special: tuple[Callable[[Column], Column], ...]
    rule_of: tuple[int, ...]
    #: Of each number of a rule with given matches, its place among all numbers.
    given: tuple[int, ...]

    @staticmethod
    def of(rules: Sequence[Detector], protected: Sequence[Pattern] = PROTECTED) -> _Plan:
        patterns = [(i, p) for i, d in enumerate(rules) for p in d.patterns] + [(-1, p) for p in protected]
        special = [(i, s) for i, d in enumerate(rules) for s in d.special]
        given = {d.given: i for i, d in enumerate(rules) if d.given is not None}
        before = len(patterns) + len(special)
        places = {key: before + n for n, key in enumerate(given)}
        return _Plan(
            rules, tuple(p for _, p in patterns), tuple(s for _, s in special), (*(i for i, _ in (*patterns, *special)), *given.values()),
            tuple(places.get(key, -1) for key in range(max(given, default=-1) + 1)),
        )

    def by_rule(self, only: str, of: Callable[[Sequence[int]], str], otherwise: str) -> str:
        """SQL: by the rule in the column `only`, what `of` gives for the numbers of that rule's patterns and those that they are sought within."""
        every, cases = with_contexts(self.patterns), []
        for i, d in enumerate(self.rules):
            own = [n for n, r in enumerate(self.rule_of[: len(self.patterns)]) if r == i]
            around = {id(self.patterns[n].within) for n in own}
            own += [n for n in range(len(self.patterns), len(every)) if id(every[n]) in around]
            if own:
                cases.append(f"WHEN '{d.id}' THEN {of(own)}")
        return f"CASE {only} {' '.join(cases)} ELSE {otherwise} END" if cases else otherwise

    def found(self, text: str, hits: str, only: str | None = None) -> Column:
        def numbered(spans: Column, number: int) -> Column:
            none = F.lit(None).cast("string")
            return F.transform(spans, lambda s: F.struct(F.lit(number).alias("p"), *(s[n].alias(n) for n in ("start", "end", "value")), *(none.alias(n) for n in ("before", "after", "extra")), s["confidence"].alias("confidence")))

        asked = lambda n, spans: F.when(F.col(only) == self.rules[self.rule_of[n]].id, spans).otherwise(no_spans()) if only else spans
        made = [numbered(asked(len(self.patterns) + i, s(F.col(text))), len(self.patterns) + i).cast(f"array<{MATCH}>") for i, s in enumerate(self.special)]
        if only and made:
            made = [F.when(F.col(only).isin([d.id for d in self.rules if d.special]), F.concat(*made)).otherwise(F.array().cast(f"array<{MATCH}>"))]
        if self.given:
            known = F.filter(F.coalesce(F.col(GIVEN), F.slice(F.array(F.get(GIVEN, F.lit(0))), 1, 0)), lambda s: F.get(_numbers(self.given), s["key"]) >= 0)
            rest = lambda s: (F.lit(None).cast("string").alias("extra"), F.lit(HIGH).alias("confidence"))
            made.append(F.transform(known, lambda s: F.struct(F.get(_numbers(self.given), s["key"]).alias("p"), *(s[n].alias(n) for n in ("start", "end", "value", "before", "after")), *rest(s))))
        return F.concat(matches_of(F.col(hits), self.patterns), *(m.cast(f"array<{MATCH}>") for m in made))


def _numbers(values: Sequence[int]) -> Column:
    return F.expr(f"array({','.join(str(int(v)) for v in values)})").cast("array<int>")


def _words(values: Sequence[str]) -> Column:
    return F.split(F.lit("\u0001".join(values)), "\u0001")


def _greedy(cluster: Column) -> Column:
    """The cluster's candidates that no better kept one overlaps."""
    ranked = F.array_sort(F.transform(cluster, lambda x: F.struct((-x["c"]["priority"]).alias("a"), (-x["c"]["confidence"]).alias("b"), (x["c"]["start"] - x["c"]["end"]).alias("d"), x["c"]["start"].alias("s"), x["i"].alias("i"), x["c"].alias("c"))))
    none = F.filter(F.transform(ranked, lambda r: r["c"]), lambda _: F.lit(False))
    kept = F.aggregate(ranked, none, lambda acc, r: F.when(F.exists(acc, lambda k: overlap(k, r["c"])), acc).otherwise(F.array_append(acc, r["c"])))
    return F.transform(F.array_sort(F.transform(kept, lambda k: F.struct(k["start"].alias("at"), k.alias("k")))), lambda o: o["k"])


_NO_PLACES = "cast(array() AS array<int>)"
_STARTS = fold_sql("idx", {"end": "-1"}, {"end": "greatest(d.end, get(placed, x).until)"}, f"if(get(placed, x).at >= d.end, array(x), {_NO_PLACES})", _NO_PLACES)
#: Of candidates by start: those that touch each other, directly or through others, as arrays.
_CLUSTERS = bound(
    f"if(size(placed) = 0, {_NO_PLACES}, sequence(0, size(placed) - 1))", "idx",
    bound(f"{_STARTS}.out", "starts", "transform(starts, (s, k) -> slice(placed, s + 1, coalesce(get(starts, k + 1), size(placed)) - s))"),
)
#: Clusters of more candidates than this look up kept ones by place.
WIDE = 48


_LATER = "(NOT x.x.tidy OR NOT (d.rule <=> x.rule) OR x.until > d.most)"
#: A cluster cl without candidates that a longer or earlier one of their rule holds: in order of rule and start, longest first, those
#: which end after all before them stay.
_LONGEST = bound(
    "array_sort(transform(cl, x -> named_struct('rule', x.rule, 'at', x.at, 'length', x.at - x.until, 'i', x.i, 'until', x.until, 'x', x)))", "sorted",
    fold_sql(
        "sorted", {"rule": "cast(null AS int)", "most": "-1"}, {"rule": "x.rule", "most": "if(d.rule <=> x.rule, greatest(d.most, x.until), x.until)"},
        f"if({_LATER}, array(x.x), slice(cl, 1, 0))", "slice(cl, 1, 0)",
    ) + ".out",
)
_NEAR = "slice(d.held, x.first + 1, x.n)"
_FREE = f"(x.shield OR NOT exists({_NEAR}, q -> exists(q, k -> k.start < x.end AND x.start < k.end)))"
_HELD = f"concat(slice(d.held, 1, x.first), transform({_NEAR}, q -> array_append(q, named_struct('start', x.start, 'end', x.end))), slice(d.held, x.first + x.n + 1, g.stretches))"
_STRETCH = "cast(({} - g.base) div g.width AS int)"
#: What greedy resolution keeps of a cluster cl of many, with protected ranges, which come first and aren't kept. Kept spans lie apart,
#: so few of them are in one stretch of the text. The cluster's text is cut in as many stretches as the root of its candidates; each
#: lists the kept spans that touch it, and a candidate meets those of the stretches that it touches, up to the first that it overlaps.
_WIDE = bound(
    bound(
        """named_struct(
          'ranked', array_sort(transform(cl, x -> named_struct('z', NOT x.shield, 'a', -x.c.priority, 'b', -x.c.confidence, 'd', x.at - x.until, 's', x.at, 'i', x.i, 'x', x))),
          'base', array_min(transform(cl, x -> x.at)), 'stretches', cast(ceil(sqrt(size(cl))) AS int),
          'width', greatest(cast(ceil((array_max(transform(cl, x -> x.until)) - array_min(transform(cl, x -> x.at))) / ceil(sqrt(size(cl)))) AS int), 1))""", "g",
        bound(
            f"""transform(g.ranked, r -> named_struct('shield', r.x.shield, 'start', r.x.at, 'end', r.x.until, 'c', r.x.c,
              'first', {_STRETCH.format('r.x.at')}, 'n', {_STRETCH.format('(r.x.until - 1)')} - {_STRETCH.format('r.x.at')} + 1))""", "items",
            fold_sql(
                "items", {"held": "array_repeat(cast(array() AS array<struct<start:int,end:int>>), g.stretches)"}, {"held": f"if({_FREE}, {_HELD}, d.held)"},
                f"if({_FREE} AND NOT x.shield, array(x.c), slice(array(x.c), 1, 0))", "slice(transform(cl, x -> x.c), 1, 0)",
            ) + ".out",
        ),
    ), "chosen", "transform(array_sort(transform(chosen, c -> named_struct('at', c.start, 'c', c))), o -> o.c)",
)


def resolve(found: Column, tidy: Callable[[Column], Column] | None = None, shield: Callable[[Column], Column] | None = None) -> Column:
    """Greedy: by priority, confidence and length (all descending), start and order; kept if no kept one overlaps. By start.

    found: an array of structs with priority, confidence, start and end. tidy: whether a candidate goes if another of its rule
    (field rule) is longer and holds it, or is the same span and comes earlier. shield: whether it is a protected range, which is
    not kept itself, and nothing that overlaps it is. Only candidates that touch each other, directly or through others, are
    compared."""

    def gone(a: Column, b: Column) -> Column:
        same = (a["at"] == b["at"]) & (a["until"] == b["until"])
        holds = (b["at"] <= a["at"]) & (b["until"] >= a["until"])
        return tidy(b["c"]) & (a["c"]["rule"] == b["c"]["rule"]) & holds & (~same | (b["i"] < a["i"]))

    def best(cluster: Column) -> Column:
        if shield is None:
            return _greedy(cluster)
        return _greedy(F.filter(cluster, lambda a: ~shield(a["c"]) & ~F.exists(cluster, lambda b: shield(b["c"]) & overlap(a["c"], b["c"]))))

    def longest(cluster: Column) -> Column:
        return F.filter(cluster, lambda a: ~tidy(a["c"]) | ~F.exists(cluster, lambda b: gone(a, b))) if tidy else cluster

    rule = (lambda c: c["rule"].cast("int")) if tidy else (lambda _: F.lit(None).cast("int"))
    flag = lambda test, c: test(c) if test else F.lit(False)
    placed = F.array_sort(F.transform(found, lambda c, i: F.struct(c["start"].alias("at"), c["end"].alias("until"), i.alias("i"), c.alias("c"), rule(c).alias("rule"), flag(tidy, c).alias("tidy"), flag(shield, c).alias("shield"))))
    one = lambda cl: F.transform(cl, lambda x: x["c"])
    clusters = F.get(mapped(F.array(placed), f"placed -> {_CLUSTERS}"), F.lit(0))
    wide = lambda cl: F.get(mapped(F.array(cl), f"cl -> {bound(_LONGEST, 'cl', _WIDE) if tidy else _WIDE}"), F.lit(0))
    kept = F.flatten(F.transform(clusters, lambda cl: F.when(F.size(cl) > WIDE, wide(cl)).when(F.size(cl) > 1, let(longest(cl), best)).otherwise(one(cl))))
    return F.filter(kept, lambda c: ~shield(c)) if shield else kept


_AGAIN = "d.label <=> x.label AND d.key <=> x.key"
_NUMBER = "CASE WHEN NOT (d.label <=> x.label) THEN 1 WHEN d.first = x.first THEN d.n ELSE d.n + 1 END"
_FIRSTS = fold_sql(
    "sorted", {"label": "cast(null AS string)", "key": "cast(null AS string)", "first": "-1"}, {"label": "x.label", "key": "x.key", "first": f"if({_AGAIN}, d.first, x.i)"},
    f"array(named_struct('label', x.label, 'first', if({_AGAIN}, d.first, x.i), 'i', x.i))", "cast(array() AS array<struct<label:string,first:int,i:int>>)",
)
_COUNTED = fold_sql(
    "sorted", {"label": "cast(null AS string)", "first": "-1", "n": "0"}, {"label": "x.label", "first": "x.first", "n": _NUMBER},
    f"array(named_struct('i', x.i, 'n', {_NUMBER}))", "cast(array() AS array<struct<i:int,n:int>>)",
)
_INDEXES = f"""keys -> transform(array_sort({bound(
    f"array_sort({bound("array_sort(transform(keys, (x, i) -> named_struct('label', x.label, 'key', x.key, 'i', i)))", 'sorted', _FIRSTS)}.out)", 'sorted', _COUNTED)}.out), x -> x.n)"""


def indexes(keys: Column) -> Column:
    """Of an array of struct<label, key>, the number of each within its label, by first occurrence of its key.

    Sorted by label and key, each run's first place is known; by label and first place, runs are counted; then back in order."""
    return F.get(mapped(F.array(keys), _INDEXES), F.lit(0))


_CANDIDATE = "struct<rule:int,priority:int,p:int,start:int,end:int,value:string,before:string,after:string,confidence:int>"


def _candidates(found: Column, plan: _Plan) -> Column:
    rule_of, priority = _numbers(plan.rule_of), _numbers([d.priority for d in plan.rules] + [1000])
    numbered = F.transform(found, lambda m: F.struct(F.get(rule_of, m["p"]).alias("rule"), m.alias("m")))
    made = F.transform(numbered, lambda x: F.struct(x["rule"].alias("rule"), F.get(priority, F.when(x["rule"] < 0, len(plan.rules)).otherwise(x["rule"])).alias("priority"), *(x["m"][n].alias(n) for n in ("p", "start", "end", "value", "before", "after", "confidence"))))
    return F.array_sort(F.transform(made, lambda c: F.struct(c["rule"].alias("rule"), c["p"].alias("p"), c["start"].alias("at"), c.alias("c")))).cast(f"array<struct<rule:int,p:int,at:int,c:{_CANDIDATE}>>")


def _by_rule(c: Column, rules: Sequence[Detector], of: Callable[[Detector], Callable[[], Column] | None], key: Callable[[Detector], object], otherwise: Column) -> Column:
    """The value for the candidate's rule; rules of one key share it."""
    made, shared = otherwise, {}
    for i, d in enumerate(rules):
        if of(d) is not None:
            shared.setdefault(key(d), (of(d), []))[1].append(i)
    for value, numbers in shared.values():
        made = F.when(c["rule"] == numbers[0] if len(numbers) == 1 else c["rule"].isin(*numbers), value()).otherwise(made)
    return made


def _findings(kept: Column, numbers: Column, rules: Sequence[Detector], template: str, literals: Column) -> Column:
    """The findings, in document order, from kept candidates and their numbers."""
    ranks = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    fields = ("id", "name", "category", "severity", "explanation", "label")
    about = {n: _words([getattr(d, n) for d in rules]) for n in fields}
    about["template"] = _words([d.template or template for d in rules])
    lead = _numbers([d.review_lead for d in rules]).cast("array<boolean>")

    def finding(c: Column, i: Column) -> Column:
        of = lambda n: F.get(about[n], c["rule"])
        replacement = _by_rule(c, rules, lambda d: (lambda: d.replacement(literals, c)) if d.replacement else None, lambda d: d.replacement, F.lit(None).cast("string"))
        is_lead = F.get(lead, c["rule"])
        return F.struct(
            F.concat_ws("-", of("id"), i.cast("string"), c["start"].cast("string")).alias("id"), of("id").alias("detector_id"), of("name").alias("name"), of("category").alias("category"),
            of("severity").alias("severity"), F.element_at(ranks, c["confidence"]).alias("confidence"), of("explanation").alias("explanation"), of("label").alias("label"),
            c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), render(of("template"), of("label"), F.get(numbers, i)).alias("placeholder"),
            replacement.alias("replacement"), is_lead.alias("review_lead"), (~is_lead).alias("enabled"),
        )

    return F.transform(kept, finding)


def _keys(kept: Column, rules: Sequence[Detector], template: str) -> Column:
    label, form = _words([d.label for d in rules]), _words([d.template or template for d in rules])
    norm = lambda c: _by_rule(c, rules, lambda d: (lambda: d.normalize(c["value"])) if d.normalize else None, lambda d: d.normalize, c["value"])
    return F.transform(kept, lambda c: F.struct(F.get(label, c["rule"]).alias("label"), F.concat_ws("\u0000", F.get(form, c["rule"]), norm(c)).alias("key")))


#: From so many literals on, the gates of a scan are looked for at once before each is on its own.
MANY_LITERALS = 12


def _searched(df: DataFrame, text_col: str, plan: _Plan, only: str | None = None) -> DataFrame:
    """df with the text, the text in lower case, and the hits of all patterns, in _scan_ columns. only: a column with the id of the one
    rule whose patterns are sought in the row; gates and searches of the others aren't even looked at."""
    text, low, digit, some, gates, lines, hits = (f"_scan_{x}" for x in ("text", "low", "digit", "some", "gates", "lines", "hits"))
    out = once(df, **{text: F.coalesce(F.col(text_col), F.lit(""))})
    out = once(once(out, **{low: F.lower(F.col(text))}), **{digit: F.col(text).rlike("[0-9]")})
    literals, every = gate_literals(plan.patterns), with_contexts(plan.patterns)
    many = len(literals) >= MANY_LITERALS and not only
    out = once(out, **{some: F.col(low).rlike(any_literal(literals))}) if many else out
    by_row = (lambda of, otherwise: plan.by_rule(only, of, otherwise)) if only else (lambda of, _: of(range(len(every))))
    out = once(out, **{gates: F.expr(by_row(lambda numbers: gates_sql(text, low, digit, some if many else None, plan.patterns, numbers), "cast(array() AS array<boolean>)"))})
    is_lined = lambda i: by_line(every[i]) or bool(every[i].starts)
    lined = any(map(is_lined, range(len(every))))
    if lined:
        wanted = F.expr(by_row(lambda numbers: " OR ".join([f"get({gates}, {place})" for place, i in enumerate(numbers) if is_lined(i)]) or "false", "false"))
        out = once(out, **{lines: F.when(wanted, lines_of(F.col(text), F.col(low)))})
    sought = by_row(lambda numbers: hits_sql(text, low, digit, plan.patterns, lines if lined else None, gates, numbers), f"cast(array() AS array<{HIT}>)")
    return once(out, **{hits: F.expr(sought)}).drop(gates, some, lines)


def _prepared(df: DataFrame, text_col: str, plan: _Plan) -> DataFrame:
    """df with what _searched gives, and the candidates of all rules in _scan_found."""
    return once(_searched(df, text_col, plan), _scan_found=_candidates(plan.found("_scan_text", "_scan_hits"), plan))


def rule_matches(df: DataFrame, text_col: str = "text", options: ScanOptions | None = None, only: str | None = None) -> DataFrame:
    """df with rule_matches: what each active rule finds on its own, by rule and place, whatever other rules find there.

    only: a column with a rule's id; then a row gets the matches of that rule alone, and the patterns of others aren't sought in it."""
    rules = active_detectors(options or ScanOptions())
    plan = _Plan.of(rules, ())
    out = _searched(df.drop("rule_matches"), text_col, plan, only)
    ids, ranks, rule_of = _words([rules[i].id for i in plan.rule_of]), F.array(F.lit("low"), F.lit("medium"), F.lit("high")), _numbers(plan.rule_of)
    own = lambda m: F.struct(F.get(ids, m["p"]).alias("detector_id"), *(m[n].alias(n) for n in ("start", "end", "value")), F.element_at(ranks, m["confidence"]).alias("confidence"))
    placed = lambda every: F.array_sort(F.transform(every, lambda m: F.struct(F.get(rule_of, m["p"]).alias("rule"), m["p"].alias("p"), m["start"].alias("at"), m.alias("m"))))
    made = let(plan.found("_scan_text", "_scan_hits", only), lambda every: F.when(F.size(every) > 1, F.transform(placed(every), lambda x: own(x["m"]))).otherwise(F.transform(every, own)))
    if only:
        made = F.filter(made, lambda m: m["detector_id"] == F.col(only)) if plan.given else made
        searched = F.exists("_scan_hits", lambda h: h.isNotNull()) | F.col(only).isin([d.id for d in rules if d.special])
        made = F.when(searched if not plan.given else F.lit(True), made).otherwise(F.array().cast("array<struct<detector_id:string,start:int,end:int,value:string,confidence:string>>"))
    return once(out, rule_matches=made).drop("_scan_text", "_scan_low", "_scan_digit", "_scan_hits")


def find_candidates(df: DataFrame, text_col: str = "text", options: ScanOptions | None = None) -> DataFrame:
    """df with candidates, all matches of the active rules by number, protected ranges with -1, and literals, the strings that
    replacements look at: all that `resolve_candidates` needs of the text. Columns of those names are replaced; a null text is empty."""
    rules = active_detectors(options or ScanOptions())
    out = _prepared(df.drop("candidates", "literals"), text_col, _Plan.of(rules))
    found = F.transform("_scan_found", lambda x: x["c"])
    quoted = F.when(F.size("_scan_found") > 0, string_literals(F.col("_scan_text"))).otherwise(no_spans()) if any(d.replacement for d in rules) else no_spans()
    return out.withColumns({"candidates": found, "literals": quoted}).drop("_scan_text", "_scan_low", "_scan_digit", "_scan_hits", "_scan_found")


def chosen_rules(known: ScanOptions, options: ScanOptions) -> list[bool]:
    """Of each active rule of `known`, whether `options` has it too; an error if that has others."""
    rules, wanted = active_detectors(known), active_detectors(options)
    own = {d.id for d in registry()}
    same = lambda a, b: a.id == b.id if a.id in own else a == b
    missing = [d.id for d in wanted if not any(same(d, r) for r in rules)]
    if missing:
        raise ValueError(f"no candidates of these rules: {', '.join(missing)}")
    return [any(same(d, r) for d in wanted) for r in rules]


def kept_candidates(found: Column, chosen: Column, rules: Sequence[Detector]) -> Column:
    """Those candidates that a scan keeps, of the rules for which the array `chosen` has true, by place."""
    tidied = [i for i, d in enumerate(rules) if d.tidy]
    tidy = (lambda c: c["rule"].isin(*tidied)) if tidied else None
    return resolve(F.filter(found, lambda c: (c["rule"] < 0) | F.get(chosen, c["rule"])), tidy, lambda c: c["rule"] < 0)


def resolve_candidates(df: DataFrame, known: ScanOptions, options: ScanOptions, chosen: Column | None = None) -> DataFrame:
    """df, from find_candidates under `known`, with the findings that a scan under `options` gives, whose rules are among those.

    chosen: of each row an array that says for each rule of `known` whether it is active there, in place of the rules of `options`."""
    rules = active_detectors(known)
    if chosen is None:
        chosen = F.array(*map(F.lit, chosen_rules(known, options))) if rules else F.array().cast("array<boolean>")
    out = once(df.drop("findings"), _scan_kept=F.when(F.size("candidates") > 0, kept_candidates(F.col("candidates"), chosen, rules)).otherwise(F.array().cast(f"array<{_CANDIDATE}>")))
    return _with_findings(out, rules, options.template, F.col("literals")).drop("_scan_kept", "candidates", "literals")


def every_rule(choices: Iterable[ScanOptions]) -> ScanOptions:
    """Options with the rules of all choices."""
    choices, ids = list(choices), {d.id for d in registry()}
    templates = {o.template for o in choices}
    extra = tuple(dict.fromkeys(d for o in choices for d in o.extra))
    return ScanOptions(frozenset(d.id for o in choices for d in active_detectors(o) if d.id in ids), extra, templates.pop() if len(templates) == 1 else DEFAULT_TEMPLATE)


def scan_choices(df: DataFrame, choices: Mapping[str, ScanOptions], text_col: str = "text") -> DataFrame:
    """df with a row for each choice: its name, in column choice, and the findings that a scan under its options gives. Texts are
    searched once, for the rules of all choices. These have one template, and their further rules one order."""
    known = every_rule(choices.values())
    if any(o.template != known.template for o in choices.values()):
        raise ValueError("choices with different templates")
    if any(list(o.extra) != [d for d in known.extra if d in o.extra] for o in choices.values()):
        raise ValueError("choices with further rules in different orders")
    masks = F.array(*(F.struct(F.lit(name).alias("choice"), F.array(*map(F.lit, chosen_rules(known, o))).cast("array<boolean>").alias("chosen")) for name, o in choices.items()))
    found = find_candidates(df.drop("choice", "findings"), text_col, known)
    each = found.select("*", F.explode(masks).alias("_scan_choice")).select("*", F.col("_scan_choice.choice").alias("choice"))
    return resolve_candidates(each, known, known, F.col("_scan_choice.chosen")).drop("_scan_choice")


def _with_findings(out: DataFrame, rules: Sequence[Detector], template: str, literals: Column) -> DataFrame:
    """out with findings of the candidates in _scan_kept."""
    kept = F.col("_scan_kept")
    out = once(out, _scan_numbers=F.when(F.size(kept) > 0, indexes(_keys(kept, rules, template))).otherwise(F.array().cast("array<int>")))
    return once(out, findings=_findings(kept, F.col("_scan_numbers"), rules, template, literals)).drop("_scan_numbers")


def scan(df: DataFrame, text_col: str = "text", options: ScanOptions | None = None) -> DataFrame:
    """df with findings, an array in document order. A column of that name is replaced; a null text is empty."""
    options = options or ScanOptions()
    names = [f"_scan_{x}" for x in ("text", "low", "digit", "hits", "found", "literals", "kept", "numbers")]
    text, _, _, _, found, literals, kept, numbers = names
    rules = active_detectors(options)
    plan = _Plan.of(rules)
    tidied = [i for i, d in enumerate(rules) if d.tidy]
    tidy = (lambda c: c["rule"].isin(*tidied)) if tidied else None
    out = _prepared(df.drop("findings"), text_col, plan)
    resolved = resolve(F.transform(F.col(found), lambda x: x["c"]), tidy, lambda c: c["rule"] < 0)
    out = once(out, **{kept: F.when(F.size(found) > 0, resolved).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))})
    quoted = string_literals(F.col(text)) if any(d.replacement for d in rules) else no_spans()
    out = once(out, **{literals: F.when(F.size(kept) > 0, quoted).otherwise(no_spans()), numbers: F.when(F.size(kept) > 0, indexes(_keys(F.col(kept), rules, options.template))).otherwise(F.array().cast("array<int>"))})
    return once(out, findings=_findings(F.col(kept), F.col(numbers), rules, options.template, F.col(literals))).drop(*names)


def finding_rows(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each finding, with its place in the document."""
    return scanned.select(id_col, F.posexplode("findings").alias("pos", "f")).select(id_col, "pos", "f.*")


__all__ = ["ScanOptions", "find_candidates", "finding_rows", "resolve_candidates", "indexes", "protected_ranges", "resolve", "rule_matches", "scan", "scan_choices"]
