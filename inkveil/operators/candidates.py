"""Terms worth hiding that no rule found: runs of capitalised words and acronyms, grouped, ranked and cut to a few per document.

Occurrences are native span expressions; grouping and ranking are an aggregate and a window over (document, key)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spans import HIGH, SPAN, Pattern, fold, let, matches, no_spans, once, spans
from .names import STOP_WORDS
from .scan import protected_ranges

MAX_CANDIDATES, MAX_LENGTH = 15, 120

# Fixed values.
CONNECTORS = ("of", "and", "&", "de", "van", "der", "da", "the")
CALENDAR = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep",
    "sept", "oct", "nov", "dec", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
)
COLORS = ("black", "darkblue", "darkgreen", "darkcyan", "darkred", "darkmagenta", "darkyellow", "gray", "darkgray", "blue", "green", "cyan", "red", "magenta", "yellow", "white")
KEYWORDS = (
    "function", "param", "begin", "process", "end", "try", "catch", "finally", "foreach", "while", "switch", "return", "break", "continue", "if", "else", "do", "until", "throw",
    "true", "false", "null",
)
PLAIN_WORDS = (
    "added", "removed", "updated", "created", "deleted", "failed", "error", "warning", "success", "completed", "starting", "started", "stopped", "running", "done", "loading",
    "processing", "access", "value", "type", "status", "result", "count", "total", "output", "input", "date", "cloak", "list",
)
TECHNICAL_ACRONYMS = (
    "ID", "AD", "OU", "DN", "DC", "CN", "IP", "DNS", "URL", "URI", "API", "CLI", "GUI", "OS", "VM", "DB", "SQL", "CSV", "TSV", "XML", "JSON", "YAML", "HTML", "HTTP", "HTTPS",
    "FTP", "SSH", "TCP", "UDP", "EXE", "DLL", "MSI", "PDF", "ZIP", "LOG", "TXT", "RAM", "CPU", "GPU", "USB", "LAN", "WAN", "VPN", "UTC", "GMT", "ISO", "UI", "UX", "QA", "CI",
    "CD", "PS", "WMI", "GPO", "SID", "UPN", "ACL", "NTFS", "SMTP", "TLS", "SSL", "JWT", "MFA", "SSO", "REST", "KB", "MB", "GB", "TB", "AM", "PM", "OK", "ERR", "WARN", "INFO",
    "DEBUG", "NIS", "BT", "NIC", "DOB", "SIN", "AWS",
)
DATE_FORMATS = ("YYYY", "YY", "MM", "MMM", "MMMM", "DD", "HH", "SS", "MS")
GENERIC_PHRASES = (
    "not set", "not applicable", "not available", "fax", "access type", "account type", "active directory", "azure active directory", "entra id", "exchange online",
    "exchange server", "microsoft exchange", "microsoft teams", "microsoft office", "microsoft graph", "windows server", "windows update", "group policy", "task scheduler",
    "scheduled task", "scheduled tasks", "domain controller", "distribution list", "distribution group", "security group", "service account", "shared mailbox",
    "user principal name", "display name", "first name", "last name", "full name", "user name", "start date", "end date", "due date", "hire date", "created date",
    "modified date", "activation date", "deactivation date", "last logon", "last modified", "file share", "file server", "print server", "remote desktop", "control panel",
    "event viewer", "event log", "recycle bin", "organizational unit", "operating system", "power shell", "visual studio", "internet explorer", "google chrome",
    "microsoft edge",
)
NO_ACRONYMS = sorted({*TECHNICAL_ACRONYMS, *DATE_FORMATS, *(w.upper() for w in (*STOP_WORDS, *CALENDAR) if 2 <= len(w) <= 6)})

_OPEN, _CLOSE = r"""[(\[{"'“‘]*""", r"""[)\]}"'”’.,;!?]*"""
_TITLE, _GAP, _OVER = "[A-Z][a-z]+", r"[^\S\r\n]", r"(?=\s|\z)"
_LINK = rf"(?i:{'|'.join(CONNECTORS)})"
#: A word of a run, which may have punctuation after it, though no : or =, or a connector; group 1 is what leads to it. One match for each
#: word: a pattern for whole runs would recurse with their length.
RUN_WORD = rf"((?<!{_GAP}){_GAP}*+(?<!\S){_OPEN})({_TITLE}(?={_CLOSE}{_OVER})|{_LINK}(?=\s))"
ACRONYM = r"\b[A-Z]{2,6}\b"


def title_runs(text: Column) -> Column:
    """array<SPAN> of runs with a word that isn't a plain one. A run starts and ends with a capitalised word, and goes on over words
    and connectors that nothing but blanks separates."""
    plain = [*STOP_WORDS, *CALENDAR, *COLORS, *KEYWORDS, *PLAIN_WORDS]
    words = lambda v: F.regexp_extract_all(v, F.lit(rf"(?<![A-Za-z]){_TITLE}"), F.lit(0))
    run = lambda d: F.struct(*(d[n].alias(n) for n in ("start", "end", "value")), F.lit(HIGH).alias("confidence"))

    def step(d: Column, x: Column) -> tuple[dict[str, Column], Column]:
        title, on = x["value"].rlike(rf"^{_TITLE}\z"), x["start"] - F.length(x["extra"]) == d["edge"]
        # What is longer than any run that is kept needs no text.
        more = lambda head: F.when(x["end"] - d["start"] <= MAX_LENGTH, F.concat(head, x["extra"], x["value"])).otherwise(head)
        after = {
            "start": F.when(title & ~on, x["start"]).otherwise(d["start"]), "end": F.when(title, x["end"]).otherwise(d["end"]),
            "value": F.when(title & on, more(F.concat(d["value"], d["links"]))).when(title, x["value"]).otherwise(d["value"]),
            "links": F.when(~title & on, more(d["links"])).otherwise(F.lit("")), "edge": F.when(title | on, x["end"]).otherwise(F.lit(-1)),
        }
        return after, F.when(title & ~on & (d["start"] >= 0), F.array(run(d))).otherwise(no_spans())

    begin = {"start": F.lit(-1), "end": F.lit(-1), "value": F.lit(""), "links": F.lit(""), "edge": F.lit(-1)}
    found = let(matches(text, [Pattern(RUN_WORD, (2,), extra=1)]), lambda m: fold(m, begin, step, SPAN))
    runs = let(found, lambda d: F.concat(d["out"], F.when(d["start"] >= 0, F.array(run(d))).otherwise(no_spans())))
    return F.filter(runs, lambda s: (s["end"] - s["start"] <= MAX_LENGTH) & F.exists(words(s["value"]), lambda w: ~F.lower(w).isin(plain)))


def acronyms(text: Column) -> Column:
    return F.filter(spans(text, ACRONYM), lambda s: ~s["value"].isin(NO_ACRONYMS))


def candidate_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[ \t ]+", " "))


def outside(found: Column, taken: Column) -> Column:
    """Of an array of structs with start and end, those that no span of `taken` overlaps, by start.

    One sweep over both by start: a span is hit if an earlier one of `taken` ends after its start. Another one backwards: it is hit if the
    next one of `taken` starts before its end."""
    place = lambda x, mine, what: F.struct(x["start"].alias("at"), F.lit(mine).alias("mine"), x["end"].alias("end"), what.alias("x"))
    none = F.get(F.slice(found, 1, 0), F.lit(0))
    every = F.array_sort(F.concat(F.transform(taken, lambda t: place(t, False, none)), F.transform(found, lambda s: place(s, True, s))))

    def sweep(items: Column, begin: int, passed: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]) -> Column:
        def step(d: Column, o: Column) -> tuple[dict[str, Column], Column]:
            kept = ~o["mine"] | passed(d["edge"], o)
            return {"edge": F.when(o["mine"], d["edge"]).otherwise(after(d["edge"], o))}, F.when(kept, F.array(o)).otherwise(F.slice(F.array(o), 1, 0))

        return fold(items, {"edge": F.lit(begin)}, step, F.slice(items, 1, 0))["out"]

    def both(ordered: Column) -> Column:
        ahead = sweep(ordered, -1, lambda edge, o: edge <= o["at"], lambda edge, o: F.greatest(edge, o["end"]))
        return let(F.reverse(ahead), lambda back: sweep(back, 2**31 - 1, lambda edge, o: edge >= o["end"], lambda edge, o: F.least(edge, o["at"])))

    return F.transform(F.filter(F.reverse(let(every, both)), lambda o: o["mine"]), lambda o: o["x"])


def _taken(text: Column) -> Column:
    """Where findings and protected patterns are."""
    place = lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))
    return F.concat(F.transform("findings", place), F.transform(protected_ranges(text), place))


def acronym_counts(scanned: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text, count) of the acronyms outside findings and protected ranges."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = once(scanned.select(id_col, text_col, "findings"), taken=_taken(text), found=acronyms(text))
    rows = held.select(id_col, F.explode(outside(F.col("found"), F.col("taken"))).alias("s"))
    return rows.groupBy(id_col, F.col("s.value").alias("text")).agg(F.count(F.lit(1)).alias("count"))


def candidates(scanned: DataFrame, text_col: str = "text", id_col: str = "doc_id", dismissed: Sequence[str] | DataFrame = (), most: int = MAX_CANDIDATES) -> DataFrame:
    """(id, rank, text, count, first_start, generic): acronyms, runs of two words or more, and words that come twice; without
    the dismissed ones; common phrases last. dismissed: terms, or a table with them in column `term`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_kind = lambda kind, found: F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    kinds = [of_kind(0, title_runs(text)), of_kind(1, acronyms(text))]
    held = once(scanned.select(id_col, text_col, "findings"), taken=_taken(text), found=F.concat(*kinds))
    rows = held.select(id_col, F.explode(outside(F.col("found"), F.col("taken"))).alias("o")).select(id_col, "o.*")
    words = F.when(F.col("kind") == 0, F.regexp_count("value", F.lit(rf"(?<![A-Za-z]){_TITLE}"))).otherwise(F.lit(0))
    grouped = rows.withColumn("key", candidate_key(F.col("value"))).withColumn("words", words).groupBy(id_col, "key").agg(
        F.min_by("value", F.struct("kind", "start")).alias("text"), F.count(F.lit(1)).alias("count"), F.min("start").alias("first_start"),
        F.bool_or(F.col("words") >= 2).alias("several"), F.bool_or((F.col("kind") == 1) | (F.col("words") >= 2)).alias("at_once"),
    )
    open_ = grouped.filter(F.col("at_once") | (F.col("count") >= 2))
    if isinstance(dismissed, DataFrame):
        open_ = open_.join(dismissed.select(candidate_key(F.col("term")).alias("key")), "key", "left_anti").select(grouped.columns)
    else:
        open_ = open_.filter(~F.col("key").isin([d.lower() for d in dismissed]))
    ranked = open_.withColumn("generic", F.col("key").isin(*GENERIC_PHRASES))
    order = W.partitionBy(id_col).orderBy("generic", F.desc("several"), F.desc("count"), "first_start")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(id_col, "rank", "text", "count", "first_start", "generic")
