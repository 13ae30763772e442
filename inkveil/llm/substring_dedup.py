"""Removal of passages that occur more than once, by super-k-mers.

Each run of `window` words is a window. Its minimiser is the least hash of the `MER`-word runs in it. Consecutive windows
of one minimiser form a super-k-mer: they travel as one packed string (the run's words once, joined by spaces) to the
minimiser's bucket. Equal windows have equal minimisers, so each bucket, by sorting its windows, counts them exactly.

Skew: a first pass finds the word runs that would be the minimisers of many super-k-mers (a boilerplate line, a much copied
text). They are demoted, so that a window takes them only if it has no other run, and a text that merely holds such a line
spreads over other buckets. Equal packed strings of a batch are packed once with the list of their places, so a group of
copies costs a batch one string. The number of buckets follows the measured volume.

Defined cases: a null or empty text has no words, and yields an empty text; null ids are ids like others; repeated rows
(same id, same text) are texts of their own, so all their windows repeat; a very long text goes through like others, its windows over
many buckets; an empty table gives an empty table; other columns are passed on, whatever their names, and columns named as an added
one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fresh, pieces, run_hashes

#: Words of the runs that serve as minimisers.
MER = 4
#: A run that is the minimiser of more than this share of the super-k-mers is demoted; at most twice its inverse are listed.
HOT_SHARE = 1 / 20_000
#: Bytes of packed strings to a bucket, on average.
BUCKET_BYTES = 2_000_000
#: Bytes of text whose packed strings a task gathers before it sends them off.
PACK_BYTES = 8_000_000
#: Bytes of packed strings to a task that counts, on average, where that needs more tasks than shuffles have partitions.
TASK_BYTES = 256_000_000
_TOP = np.uint64(1 << 63)
PARTS = "bucket int, ids array<bigint>, text_keys array<bigint>, starts array<int>, places array<int>, packed binary"


def _super_kmers(words: Words, window: int, mer: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer: its text, first word, number of windows and minimiser."""
    count = np.diff(words.first)
    n = len(words.start)
    if n < window:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    order = run_hashes(words.hashes(), mer) >> np.uint64(1)
    if len(hot):
        at = np.searchsorted(hot, order)
        order[hot[np.minimum(at, len(hot) - 1)] == order] |= _TOP
    least, have, want = order, 1, window - mer + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    text = np.repeat(np.arange(len(count)), count)
    last = np.repeat(words.first[1:], count) - window  # the last word that starts a window of its text
    at = np.flatnonzero(np.arange(n) <= last)
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    value, owner = least[at], text[at]
    new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
    windows = np.diff(np.concatenate([new, [len(at)]]))
    return owner[new], at[new], windows, value[new]


def _heavy(df: DataFrame, window: int, mer: int) -> tuple[np.ndarray, int]:
    """The word runs to demote, sorted, and the bytes that all packed strings have.

    Each task sums up its runs in a list of at most `listed`, from which it takes as much from each count as keeps it that short: no
    count is then too small by more than a 1 / listed of all. So every run of more than HOT_SHARE has half of that share at least,
    and at most `listed` runs have that. What a task has only once isn't told: a run that is once in each of very many small tasks
    isn't demoted, which costs a larger bucket and no result."""
    listed = int(2 / HOT_SHARE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        values, sums, total, size = none, np.empty(0, np.int64), 0, 0
        for batch in batches:
            found = []
            for piece in pieces(batch):
                words = Words(piece.column("text"))
                _, first, windows, value = _super_kmers(words, window, mer, none)
                found.append(value)
                total += len(value)
                size += int((words.end[first + windows + window - 2] - words.start[first]).sum()) if len(first) else 0
            more, n = np.unique(np.concatenate([none, *found]), return_counts=True)
            values, where = np.unique(np.concatenate([values, more]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, n]), len(values)).astype(np.int64)
            if len(values) > listed:
                sums = sums - np.partition(sums, len(sums) - listed - 1)[len(sums) - listed - 1]
                values, sums = values[sums > 0], sums[sums > 0]
        values, sums = values[sums > 1], sums[sums > 1]
        yield pa.record_batch([pa.array([-1, -2]), pa.array([total, size])], ["mer", "n"])
        yield pa.record_batch([pa.array(values.astype(np.int64)), pa.array(sums)], ["mer", "n"])

    sums = df.select("text").mapInArrow(count, "mer bigint, n bigint").groupBy("mer").agg(F.sum("n").alias("n"))
    sums = sums.persist()
    totals = {r.mer: r.n for r in sums.filter("mer < 0").collect()}
    least = max(50, totals.get(-1, 0) * HOT_SHARE / 2)
    hot = sums.filter((F.col("mer") >= 0) & (F.col("n") > least)).select("mer").toPandas()["mer"].to_numpy()
    sums.unpersist()
    return np.sort(hot.astype(np.uint64)), int(totals.get(-2, 0))


def _packed(df: DataFrame, window: int, mer: int, hot, buckets: int) -> DataFrame:
    """A row for each batch and bucket: the distinct packed strings (compressed together), how many places each has, and the places."""

    schema = pa.schema([("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("text_keys", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("packed", pa.binary())])

    def rows(bins: dict[int, dict[bytes, list]]) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1)
        columns: list[list] = [[] for _ in schema]
        for bucket, strings in bins.items():
            places = [p for found in strings.values() for p in found]
            ids, keys, starts = (list(x) for x in zip(*places, strict=True))
            for column, x in zip(columns, (bucket, ids, keys, starts, [len(found) for found in strings.values()], squeeze.compress(b"\n".join(strings))), strict=True):
                column.append(x)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        demoted = hot.value
        bins: dict[int, dict[bytes, list]] = {}
        size = 0
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column("text"))
                owner, first, windows, value = _super_kmers(words, window, mer, demoted)
                if not len(owner):
                    continue
                ids, keys = piece.column("id").to_pylist(), piece.column("text_key").to_pylist()
                raw = words.joined.tobytes()
                spans = zip(
                    (value % np.uint64(buckets)).tolist(), owner.tolist(), (first - words.first[owner]).tolist(),
                    words.start[first].tolist(), words.end[first + windows + window - 2].tolist(), strict=True,
                )
                for bucket, t, start, a, b in spans:
                    bins.setdefault(bucket, {}).setdefault(raw[a:b], []).append((ids[t], keys[t], start))
                size += len(raw)
                if size > PACK_BYTES:
                    yield rows(bins)
                    bins, size = {}, 0
        if bins:
            yield rows(bins)

    return df.mapInArrow(pack, PARTS)


def _repeated(strings: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    """Of each packed string, which of its windows start in two places or more."""
    words = Words(pa.array(strings, pa.binary()))
    hashes = words.hashes()
    total = run_hashes(hashes, window)
    count = np.diff(words.first)
    string = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.arange(len(hashes)) <= np.repeat(words.first[1:], count) - window)
    order = at[np.argsort(total[at])]
    same = np.flatnonzero(total[order[1:]] == total[order[:-1]])
    again = np.zeros(len(hashes), bool)
    again[at] = places[string[at]] > 1
    if len(same):
        raw, a, b = words.joined.tobytes(), words.start, words.end
        left, right = order[same], order[same + 1]
        equal = np.fromiter((raw[p:q] == raw[r:s] for p, q, r, s in zip(a[left].tolist(), b[left + window - 1].tolist(), a[right].tolist(), b[right + window - 1].tolist(), strict=True)), bool, len(same))
        again[left[equal]] = again[right[equal]] = True
        for value in np.unique(total[left[~equal]]):  # different windows with one hash: count the words themselves
            seen: dict[bytes, list[int]] = {}
            for i in at[total[at] == value].tolist():
                seen.setdefault(raw[a[i] : b[i + window - 1]], []).append(i)
            for found in seen.values():
                again[found] |= len(found) > 1
    return [again[words.first[i] : words.first[i] + count[i] - window + 1] for i in range(len(strings))]


def _spans(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The words that the flagged windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) + window - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _counted(parts: DataFrame, window: int, partitions: int) -> DataFrame:
    """The covered word spans, from the buckets."""
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def of_bucket(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        merged: dict[bytes, list] = {}
        for row in rows:
            at = 0
            for string, n in zip(expand.decompress(row["packed"]).split(b"\n"), row["places"], strict=True):
                merged.setdefault(string, []).append((row, at, n))
                at += n
        strings = list(merged)
        flags = _repeated(strings, np.array([sum(p[2] for p in merged[s]) for s in strings]), window)
        ids, keys, lo, hi = [], [], [], []
        for string, flag in zip(strings, flags, strict=True):
            if not flag.any():
                continue
            for a, b in _spans(flag, window):
                for row, at, n in merged[string]:
                    ids += row["ids"][at : at + n]
                    keys += row["text_keys"][at : at + n]
                    lo += [a + s for s in row["starts"][at : at + n]]
                    hi += [b + s for s in row["starts"][at : at + n]]
            if len(ids) > 200_000:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip((ids, keys, lo, hi), schema, strict=True)], schema=schema)
                ids, keys, lo, hi = [], [], [], []
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip((ids, keys, lo, hi), schema, strict=True)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["bucket"] != bucket and held:
                    yield from of_bucket(held)
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield from of_bucket(held)

    dealt = parts.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, "id bigint, text_key bigint, lo int, hi int")


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, mer: int = MER) -> DataFrame:
    """df with n_words, n_removed and kept_text (the words that no repeated window covers, joined by one space).

    A window is `window` consecutive words of a text; it is repeated if its words also start anywhere else in the table."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    hot, size = _heavy(base, window, mer)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(partitions, size // TASK_BYTES)
    buckets = max(partitions, min(2**31 - 1, size // BUCKET_BYTES))
    parts = _packed(base, window, mer, spark.sparkContext.broadcast(hot), buckets)
    spans = _counted(parts, window, partitions).groupBy("id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))

    added = ["n_words", "n_removed", "kept_text"]
    passed = [c for c in df.columns if c not in added]
    key, there, spans_of = (fresh(passed, n) for n in ("text_key", "found", "spans"))
    keyed = df.select(*passed, F.xxhash64(text_col).alias(key))
    spans = spans.select(F.struct("id", "text_key").alias(there), F.col("_spans").alias(spans_of))
    same = (F.col(key) == F.col(f"{there}.text_key")) & keyed[id_col].cast("bigint").eqNullSafe(F.col(f"{there}.id"))
    joined = keyed.join(spans, same, "left").drop(key, there)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                words = Words(piece.column(text_col))
                raw, counts = words.joined.tobytes(), np.diff(words.first)
                removed, kept = [], []
                for i, spans in enumerate(piece.column(spans_of).to_pylist()):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    gone = np.zeros(b - a, bool)
                    for s in spans or ():
                        gone[s["lo"] : s["hi"]] = True
                    removed.append(int(gone.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (~gone).astype(np.int8), [0]])))
                    kept.append(b" ".join(raw[words.start[a + x] : words.end[a + y - 1]] for x, y in zip(edge[::2], edge[1::2], strict=True)))
                columns = [piece.column(c) for c in passed] + [pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, passed + added)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(passed).schema)
    return joined.mapInArrow(keep, f"{fields}, n_words bigint, n_removed bigint, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
