"""Secrets in whole texts: fixed patterns, and values in a context of credentials that are hard to guess.

Patterns give the base spans: `assign`, `access` and `hex`. A value that follows a credential's name is of kind `guess` if guessing it
costs GUESS_BITS bits or more. Its cost is that of the cheapest way to cut it into

- words of a dictionary, by their rank, with their case and with signs for letters;
- dates and years;
- repeats, the block that is repeated and its number;
- walks over neighbouring keys or letters in sequence, by length and turns;
- spans of brute force, by length and the characters that they need,

found by dynamic programming over places, with a price for every cut. Names and single words, which the dictionary has, cost little.

The dictionary is counted by Spark: the words of the letters a to z that most documents have, DICTIONARY of them, after COMMON. That is a
stated bound, and the only thing that is gathered.

Defined cases: null and empty texts have no spans; very long texts and values are read whole, in time that grows with their length; places
are code points, ends exclusive; equal spans of one kind are one; of values that end at one place the longest counts; rows are handled
one by one, so repeated ids and null ids stay; columns are passed on unless `find_secrets` adds one of that name, which it replaces; an
empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, written

ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential's name and what leads to its value, which starts where the match ends.
CONTEXT = re.compile(
    r"""(?ia)(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private)[ _-]?key|credentials?|authorization|bearer)[a-z_]{0,20}["']?"""
    r"""(?=((?:\x20*(?::=|=>|->|[:=])\x20*|\x20(?:is|was):?\x20|\x20)(?:(?:bearer|basic)\x20)?["'`]?))"""
)
VALUE_END = re.compile(r"""[\x00-\x20"'`<>(){}\[\],;]""")
VALUE_LEAST = 6
GATES = (r"(?i)pass(?:word|wd|phrase|code)|pwd|secret|token|key|credential|authorization|bearer", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "guess")

DICTIONARY, WORD_LEAST, WORD_MOST = 10_000, 3, 24
GUESS_BITS = 50.0
#: Bits for each segment: where it is cut and of which kind it is.
CUT_BITS = 2.0
PERIODS = 8

# What people choose first.
COMMON = tuple(
    "password qwerty admin welcome letmein monkey dragon master login princess sunshine football iloveyou abc secret changeme default root test guest user hello shadow superman batman "
    "trustno passw pass word love money summer winter spring autumn january february march april june july august september october november december monday friday company example demo temp".split()
)
# The rows of keys, each half a key to the right of the one above.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
# The same keys with shift.
SHIFTED = ("!@#$%^&*()_+", "QWERTYUIOP{}", 'ASDFGHJKL:"', "ZXCVBNM<>?")
# Signs that stand for letters; 1 is either.
SIGNS = ("@4301!$5+7", "aaeoiisstt")

_PLAIN = tuple(str.maketrans(SIGNS[0], SIGNS[1].replace("i", one, 1)) for one in "il")
_KEY = {c: (row, place) for rows in (KEY_ROWS, SHIFTED) for row, keys in enumerate(rows) for place, c in enumerate(keys)}
_DATE = re.compile(r"(?a)(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d")
_YEAR = re.compile(r"(?a)(?:19|20)\d\d")
YEAR_BITS, DAY_BITS = math.log2(200), math.log2(366)
#: Characters of each class: digits, small letters, capitals, other ASCII, the rest.
CLASS_SIZES = (10, 26, 26, 33, 1000)
_ALPHABET = [math.log2(max(1, sum(n for k, n in enumerate(CLASS_SIZES) if mask >> k & 1))) for mask in range(32)]
Segment = tuple[int, int, float, str]


def char_class(c: str) -> int:
    if not c.isascii():
        return 4
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def brute_bits(text: str) -> float:
    """Of a span, by length and the classes of characters that it needs."""
    mask = 0
    for c in text:
        mask |= 1 << char_class(c)
    return len(text) * _ALPHABET[mask]


def dictionary(words: Sequence[str]) -> ahocorasick.Automaton:
    """Finds words in a text, with their ranks from 1."""
    found = ahocorasick.Automaton()
    for rank, word in enumerate(dict.fromkeys(words), 1):
        found.add_word(word, (rank, len(word)))
    found.make_automaton()
    return found


def _words(value: str, known: ahocorasick.Automaton) -> Iterator[Segment]:
    low = value.lower()
    if not len(known) or len(low) != len(value):
        return
    best: dict[tuple[int, int], int] = {}
    for plain in _PLAIN:
        for end, (rank, length) in known.iter(low.translate(plain)):
            at = end + 1 - length, end + 1
            best[at] = min(rank, best.get(at, rank))
    for (i, j), rank in best.items():
        own = value[i:j]
        upper, signs = sum(c.isupper() for c in own), sum(not c.isalpha() for c in own)
        case = 0 if not upper else 1 if own.istitle() or own.isupper() else 1 + min(upper, len(own) - upper)
        yield i, j, math.log2(rank) + case + signs, "word"


def _dates(value: str) -> Iterator[Segment]:
    for i in range(len(value) - 3):
        if (m := _DATE.match(value, i)) is not None:
            yield i, m.end(), YEAR_BITS + DAY_BITS + 2 * bool(m[1] or m[2] or m[3]), "date"
        if _YEAR.match(value, i):
            yield i, i + 4, YEAR_BITS, "date"


def _repeats(value: str) -> Iterator[Segment]:
    """The longest spans of each period that hold their block twice or more."""
    for period in range(1, min(PERIODS, len(value) // 2) + 1):
        start = 0
        for i in range(period, len(value) + 1):
            if i == len(value) or value[i] != value[i - period]:
                if i - start >= 2 * period:
                    yield start, i, brute_bits(value[start : start + period]) + math.log2((i - start) / period), "repeat"
                start = i - period + 1


def _step(a: str, b: str) -> tuple[str, int, int] | None:
    """The direction in which b neighbours a, or None: in sequence of letters or digits, or on the keyboard."""
    if a.isascii() and a.isalnum() and char_class(a) == char_class(b) and abs(ord(b) - ord(a)) == 1:
        return "sequence", 0, ord(b) - ord(a)
    if a in _KEY and b in _KEY:
        down, right = _KEY[b][0] - _KEY[a][0], _KEY[b][1] - _KEY[a][1]
        if (down, right) in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
            return "keys", down, right
    return None


def _walks(value: str) -> Iterator[Segment]:
    """The longest spans of three or more characters each of which neighbours the one before."""
    start, turns, last = 0, 0, None
    for i in range(1, len(value) + 1):
        step = _step(value[i - 1], value[i]) if i < len(value) else None
        if step is None:
            if i - start >= 3:
                yield start, i, math.log2(len(_KEY)) + math.log2(i - start) + 3 * turns, "walk"
            start, turns, last = i, 0, None
        else:
            turns, last = turns + (step != last), step


def segments(value: str, known: ahocorasick.Automaton) -> list[Segment]:
    """What value may be cut into, (start, end, bits, kind), but for brute force."""
    return [*_words(value, known), *_dates(value), *_repeats(value), *_walks(value)]


def guess_bits(value: str, known: ahocorasick.Automaton) -> float:
    """The bits of the cheapest cut. Brute force is followed by the classes of its characters, so it needs no table of spans."""
    ending: list[list[tuple[int, float]]] = [[] for _ in range(len(value) + 1)]
    for i, j, bits, _ in segments(value, known):
        ending[j].append((i, bits))
    best, brute = [0.0], [math.inf] * len(_ALPHABET)
    for j, c in enumerate(value, 1):
        bit = 1 << char_class(c)
        brute = [min(b, best[j - 1]) + _ALPHABET[mask] if mask & bit else math.inf for mask, b in enumerate(brute)]
        best.append(CUT_BITS + min(min(brute), min((best[i] + bits for i, bits in ending[j]), default=math.inf)))
    return best[-1]


def values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values after credentials' names are, without stops after them."""
    end = -1
    for m in CONTEXT.finditer(text):
        start = m.end(1)
        if start <= end:  # within the last one, or it was empty
            continue
        found = VALUE_END.search(text, start)
        end = found.start() if found else len(text)
        stop = end
        while stop > start and text[stop - 1] in ".!?:":
            stop -= 1
        if stop - start >= VALUE_LEAST:
            yield start, stop


def spans(text: str, known: ahocorasick.Automaton) -> list[tuple[int, int, int, float | None]]:
    """(start, kind's place in KINDS, end, bits) in order; bits of guesses only."""
    found = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    for start, end in values(text):
        bits = guess_bits(text[start:end], known)
        if bits >= GUESS_BITS:
            found.append((start, 3, end, bits))
    return sorted(found, key=lambda s: s[:3])


def frequent_words(df: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The `size` words of letters a to z that the most texts have, ties in order.

    A histogram of the counts, in steps of a sixteenth of a power of two, tells first which words can be among them, so that tasks
    don't each send `size` words to the driver."""
    words = F.filter(F.split(F.lower(text_col), "[^a-z]+"), lambda w: F.length(w).between(WORD_LEAST, WORD_MOST))
    counted = df.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    counted = written(counted.withColumn("step", F.floor(16 * F.log2("texts"))), "secret-words")
    steps = counted.groupBy("step").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    above = list(itertools.accumulate(s.words for s in steps))
    least = next((s.step for s, n in zip(steps, above, strict=True) if n >= size), 0)
    return [r.word for r in counted.filter(F.col("step") >= least).orderBy(F.desc("texts"), "word").limit(size).collect()]


SPANS = "array<struct<kind: string, start: int, end: int, bits: double>>"


def find_secrets(df: DataFrame, text_col: str = "text", words: Sequence[str] | None = None) -> DataFrame:
    """df with secrets, an array of (kind, start, end, bits) by start and kind. words: the dictionary after COMMON, commonest first;
    by default df's own."""
    listed = [*COMMON, *(frequent_words(df, text_col) if words is None else words)]
    names = [c for c in df.columns if c != "secrets"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(listed)
        for batch in batches:
            for piece in pieces(batch, text_col):
                texts = pc.fill_null(piece.column(text_col), "")
                passed = [pc.match_substring_regex(texts, g) for g in GATES]
                looked = pc.or_(pc.or_(passed[0], passed[1]), passed[2])
                found = [[] if not look.as_py() else [{"kind": KINDS[k], "start": s, "end": e, "bits": b} for s, k, e, b in spans(t.as_py(), known)] for look, t in zip(looked, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(found, kind)], [*names, "secrets"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), f"secrets {SPANS}"])
    return df.select(names).mapInArrow(run, schema)


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(table).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("secrets")).alias("spans"))
