"""Repair of conversations by the cheapest edits, each distinct sequence of roles and faults solved once.

1. Rows are sorted by conversation and turn over the whole table (a range partition, which may cut a conversation) and packed in pieces
   of PIECE_ROWS rows and PIECE_BYTES at most, each with its signature: one letter a row for its role and fault.
2. A distinct signature is solved once: a memoised recursion gives the least cost from each row and state of the wanted sequence of
   roles, and a walk along least costs takes the ASCII-least edit at each step.
3. Nearly all conversations are one piece. In others, a piece's least costs between its first and last states are composed from the
   end backwards, and the states in which pieces start from the beginning; what is gathered for a conversation is some 100 bytes for
   each piece, less than its audit.
4. Audits join the pieces by number, and edits are replayed row by row.

The roles are to be `(s?(ua)+)?`. Keep costs nothing, Rerole `rerole`, Delete `delete`, Insert `insert`; rows that are truncated and
not deleted cost `truncated` more. Blank rows and duplicates are deleted.

Defined cases: null roles and texts are one space; a null conversation id is a conversation; null turns come first; rows of one turn are
in order of role and text; a role without a letter, or with one that isn't s, u or a, can't be kept; repeated rows are duplicates; very
long texts make pieces of their own; gaps beyond 64 bits are null; further columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PIECE_ROWS, PIECE_BYTES = 200, 1_000_000
SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States of the wanted sequence: nothing yet, after s, after u, after a. What each expects, and what follows a role.
EXPECTED = "uuau"
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL_ROLE = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
#: The costs with which a sequence may end, by state.
END = (0, NEVER, NEVER, 0)


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Solution(NamedTuple):
    audit: str
    exit: int
    cost: int


class Signature:
    """A piece of a conversation. after: the least cost of what follows, by the state that it starts in; last: nothing follows."""

    def __init__(self, letters: str, after: tuple[int, ...] = END, last: bool = True, costs: Costs = Costs()):
        self.letters, self.after, self.last, self.costs = letters, after, last, costs
        self.least = cache(self._least)

    def _steps(self, i: int, state: int, inserted: int) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        """The edits that may come next in ASCII order: letter, cost, and the place that they lead to.

        Two inserts in a row pass through all states that any number of them reaches. What is inserted between two pieces is the
        later one's."""
        there = i < len(self.letters)
        row = self.letters[i] if there else ""
        wanted = FOLLOWS[state, EXPECTED[state]]
        extra = self.costs.truncated if row.isupper() else 0
        if there:
            yield "D", self.costs.delete, (i + 1, state, 0)
        if inserted < 2 and (there or self.last):
            yield "I", self.costs.insert, (i, wanted, inserted + 1)
        if there and (state, row.lower()) in FOLLOWS:
            yield "K", extra, (i + 1, FOLLOWS[state, row.lower()], 0)
        if there and row != "d":
            yield "R", self.costs.rerole + extra, (i + 1, wanted, 0)

    def _least(self, i: int, state: int, inserted: int) -> int:
        ended = self.after[state] if i == len(self.letters) else NEVER
        return min(NEVER, ended, *(cost + self.least(*to) for _, cost, to in self._steps(i, state, inserted)))

    def solve(self, state: int) -> Solution:
        """The cheapest edits from a state at the start, of equal ones the ASCII-least, and the state at the end."""
        audit, at = [], (0, state, 0)
        if self.least(*at) >= NEVER:
            return Solution("", state, NEVER)
        while True:
            left = self.least(*at)
            if at[0] == len(self.letters) and self.after[at[1]] == left:
                return Solution("".join(audit), at[1], self.least(0, state, 0) - left)
            letter, at = next((letter, to) for letter, cost, to in self._steps(*at) if cost + self.least(*to) == left)
            audit.append(letter)

    def between(self) -> list[int]:
        """The least costs from each state at the start to each state at the end, 16 in all."""
        ends = [Signature(self.letters, tuple(0 if s == t else NEVER for s in range(4)), False, self.costs) for t in range(4)]
        return [e.least(0, s, 0) for s in range(4) for e in ends]


def replay(turns: list[dict], letters: str, audit: str, state: int) -> list[dict]:
    """The rows of a piece after an audit that starts in a state."""
    out, rows = [], iter(zip(turns, letters, strict=True))
    for edit in audit:
        turn, letter = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = letter.lower() if edit == "K" else EXPECTED[state]
        state = FOLLOWS[state, role]
        if edit == "I":
            out.append({"turn": None, "role": FULL_ROLE[role], "text": ""})
        else:
            out.append(turn if edit == "K" else turn | {"role": FULL_ROLE[role]})
    return out


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Native: df's columns conv_id, turn, role and text with faults by crc32 of id and turn: one row in 20 each is left out, emptied,
    loses its stops, comes twice, or is a user's."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(words(id_col), F.lit(":"), words(turn_col))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(words(text_col), "[.!?]", "")).otherwise(words(text_col))
    role = F.when(draw == 4, "user").otherwise(words(role_col))
    copies = F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return df.filter(draw != 0).select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault): equal rows are one with their number, and fault is the first row's: blank, duplicate,
    truncated or empty."""
    plain = df.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    known = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", "blank").when(F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate")
    return known.select("conv_id", "turn", "role", "text", "copies", fault.when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("fault"))


def _letter(role: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    own = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return own.upper() if fault == "truncated" else own


_TURN = "struct<turn: {turn}, role: string, text: string>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _packed(rows: DataFrame) -> DataFrame:
    """(conv_id, no, head, tail, signature, turns, and counts): pieces in order of no, which no two share. head and tail: the initials of
    its first and last role. Rows that are deleted in any case have no text."""
    turn = rows.schema["turn"].dataType.simpleString()
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, no bigint, head string, tail string, signature string, turns array<{_TURN.format(turn=turn)}>, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    target = _arrow(rows.sparkSession.createDataFrame([], schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        piece, held, conv, out, out_size = [], 0, None, [], 0

        def close() -> None:
            nonlocal number, piece, held, out_size
            if not piece:
                return
            initials = [role[:1] for _, role, _, _ in piece]
            kinds = [fault for *_, fault in piece]
            made = {"conv_id": conv, "no": number, "head": initials[0], "tail": initials[-1], "signature": "".join(_letter(r, f) for _, r, _, f in piece)}
            made["turns"] = [{"turn": t, "role": r, "text": None if f in ("blank", "duplicate") else x} for t, r, x, f in piece]
            made |= {k: kinds.count(k) for k in _COUNTS[:3]} | {"illegal": sum(a + b not in LEGAL for a, b in pairwise(initials))}
            out.append(made)
            number, out_size, piece, held = number + 1, out_size + held, [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if piece and row["conv_id"] != conv:
                    close()
                conv = row["conv_id"]
                for copy in range(row["copies"]):
                    size = len(row["text"])
                    if piece and (len(piece) >= PIECE_ROWS or held + size > PIECE_BYTES):
                        close()
                    again = copy > 0 and row["fault"] != "blank"
                    piece.append((row["turn"], row["role"], row["text"], "duplicate" if again else row["fault"]))
                    held += size
                    if out_size > 4 * PIECE_BYTES or len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, target)
                        out, out_size = [], 0
        close()
        yield pa.RecordBatch.from_pylist(out, target)

    order = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    return dealt.mapInArrow(pack, schema)


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """df with a row for each that `make` (of a row as a dict) gives."""
    target = _arrow(df.sparkSession.createDataFrame([], schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                made = [out for row in batch.slice(at, 500).to_pylist() for out in make(row)]
                yield pa.RecordBatch.from_pylist(made, target)

    return df.mapInArrow(run, schema)


def _told(after: list[int]) -> str:
    """Costs of what follows, by state, from the least: few texts for all that can occur."""
    least = min(after)
    return ",".join("-" if c >= NEVER else str(c - least) for c in after)


def _known(after: str) -> tuple[tuple[int, ...], bool]:
    return (END, True) if after == "end" else (tuple(NEVER if c == "-" else int(c) for c in after.split(",")), False)


def _contexts(heads: DataFrame, costs: Costs) -> DataFrame:
    """(no, after, joint) of the pieces of conversations with several: what follows each, and whether its first role follows the
    piece before it illegally."""
    several = heads.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1")
    parts = heads.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    between = _each(parts.select("signature").distinct(), lambda r: [{"s": r["signature"], "between": Signature(r["signature"], costs=costs).between()}], "s string, between array<bigint>")
    chain = parts.join(between, F.col("signature") == F.col("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "head", "tail", "between", "signature"))).alias("chain"))

    def backwards(row: dict) -> Iterator[dict]:
        chain, after, told = row["chain"], None, []
        for piece in reversed(chain):
            told.append("end" if after is None else _told(after))
            if after is None:
                closed = Signature(piece["signature"], costs=costs)
                after = [closed.least(0, s, 0) for s in range(4)]
            else:
                after = [min(NEVER, *(piece["between"][4 * s + t] + after[t] for t in range(4))) for s in range(4)]
        before = [None, *(p["tail"] for p in chain[:-1])]
        for piece, a, tail in zip(chain, reversed(told), before, strict=True):
            yield {"no": piece["no"], "after": a, "joint": int(tail is not None and tail + piece["head"] not in LEGAL)}

    return _each(chain, backwards, "no bigint, after string, joint bigint")


def _entries(solved: DataFrame) -> DataFrame:
    """(no, entry) of the pieces of conversations with several: the state that each starts in."""
    parts = solved.filter(F.col("joint").isNotNull())
    chain = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", F.col("found.exit").alias("exits")))).alias("chain"))

    def forwards(row: dict) -> Iterator[dict]:
        state = 0
        for piece in row["chain"]:
            yield {"no": piece["no"], "entry": state}
            state = piece["exits"][state]

    return _each(chain, forwards, "no bigint, entry int")


def repair(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Of rows (conv_id, turn, role, text): pieces of conversations by number (no), with counts of faults and of illegal successions
    of roles, the audit, its cost, and the repaired rows. whole: the piece is the conversation."""
    pieces = written(_packed(_rows(df)), "repair-pieces")
    heads = pieces.select("conv_id", "no", "head", "tail", "signature")
    contexts = written(_contexts(heads, costs), "repair-contexts").withColumnRenamed("no", "n")
    asked = heads.join(contexts, F.col("no") == F.col("n"), "left").select("conv_id", "no", "signature", F.coalesce("after", F.lit("end")).alias("after"), "joint")

    def solve(row: dict) -> list[dict]:
        after, last = _known(row["after"])
        known = Signature(row["signature"], after, last, costs)
        return [{"s": row["signature"], "a": row["after"], "found": [known.solve(s)._asdict() for s in range(4)]}]

    solutions = _each(asked.select("signature", "after").distinct(), solve, "s string, a string, found array<struct<audit: string, exit: int, cost: bigint>>")
    solved = asked.join(solutions, (F.col("signature") == F.col("s")) & (F.col("after") == F.col("a"))).select("conv_id", "no", "joint", "found")
    solved = written(solved, "repair-solved")
    entries = _entries(solved).withColumnRenamed("no", "n")
    entry = F.coalesce("entry", F.lit(0))
    chosen = solved.join(entries, F.col("no") == F.col("n"), "left").select(F.col("no").alias("n"), "joint", entry.alias("entry"), F.get("found", entry).alias("f"))
    met = pieces.join(chosen, F.col("no") == F.col("n")).select("conv_id", "no", F.col("joint").isNull().alias("whole"), *_COUNTS[:3], (F.col("illegal") + F.coalesce("joint", F.lit(0))).alias("illegal"), F.col("f.audit").alias("audit"), F.col("f.cost").alias("cost"), "entry", "signature", "turns")
    kept = [c for c in met.columns if c not in ("entry", "signature", "turns")]
    schema = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in kept) + f", repaired {met.schema['turns'].dataType.simpleString()}"
    return _each(met, lambda r: [{c: r[c] for c in kept} | {"repaired": replay(r["turns"], r["signature"], r["audit"], r["entry"])}], schema)


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the rows as `role:text`, joined by newlines.

    A digest is of a text in order, so the pieces of a conversation with several pass through one task, one at a time."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    told = repaired.select("conv_id", "no", "whole", (F.size("repaired") > 0).alias("some"), lines.alias("lines"))
    schema = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    target = _arrow(repaired.sparkSession.createDataFrame([], schema))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, started, begun = None, None, False, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state, started, begun = row["conv_id"], hashlib.sha256(), False, True
                if row["some"]:
                    state.update(b"\n" * started + row["lines"].encode())
                    started = True
            yield pa.RecordBatch.from_pylist(out, target)
        if begun:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], target)

    several = told.filter(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "no").drop("whole")
    return told.filter("whole").select("conv_id", F.sha2("lines", 256).alias("repaired_sha256")).unionByName(several.mapInArrow(digest, schema))


def report(rows: DataFrame, ids: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row for each conv_id of ids: gaps, counts of faults, and audit, cost and digest of the repair of its rows."""
    repaired = written(repair(rows, costs), "repaired")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "audit"))), lambda p: p["audit"]), "")
    sums = repaired.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in (*_COUNTS, "cost")), whole.alias("audit")).withColumnRenamed("conv_id", "c1")
    wide = lambda c: c.cast("decimal(38,0)")
    turn = F.col("turn")
    gaps = (wide(F.max(turn)) - wide(F.min(turn)) + 1 - F.count_distinct(turn)).try_cast("bigint")
    gaps = rows.groupBy(F.col("conv_id").alias("c2")).agg(F.when(F.count(turn) > 0, gaps).otherwise(0).alias("gaps"))
    digests = _digests(repaired).withColumnRenamed("conv_id", "c3")
    own = F.col("conv_id")
    met = ids.select("conv_id").distinct().join(gaps, own.eqNullSafe(F.col("c2")), "left").join(sums, own.eqNullSafe(F.col("c1")), "left").join(digests, own.eqNullSafe(F.col("c3")), "left")
    none = F.col("c2").isNull() & F.col("repaired_sha256").isNull()
    return met.select(
        "conv_id", F.when(none, F.lit(0).cast("bigint")).otherwise(F.col("gaps")).alias("gaps"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*_COUNTS, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(damage(table), table)
