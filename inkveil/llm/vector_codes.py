"""Vectors as short codes: each of PARTS parts of a vector is named by the nearest entry of its part's codebook.

Components are integers floor(SCALE * x). A codebook starts as the part of the ENTRIES vectors with the smallest ids; each of ROUNDS
rounds assigns all parts and moves every used entry to floor(sum / count) of its parts.

The nearest entry of a part x is that with the least s = |c|^2 - 2 x.c. All products x.c of a batch are one float32 matrix product p,
whose error is bounded: with u = 2^-24 and d components, operands rounded to float32 and any order of summation,
|p - x.c| <= g |x| |c| for g = (d + 2) u / (1 - (d + 2) u). So s lies in an interval about |c|^2 - 2 p, and entries whose interval
starts beyond the least end of any can't be nearest. If more than one is left, those are evaluated again in int64; the least distance
wins, then the lower index. Codes are exact, whatever the float32 products were.

Batches are assigned where they lie. Only sums and counts of entries are shuffled, and codebooks (ENTRIES vectors) go to the driver
and back.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors, empty ones too, count as
filled with zeros up to the longest one's length, made a multiple of PARTS; integers and errors are held at the ends of 64 bits, with
distances of large integers evaluated without bounds; null ids count as larger than all others, and rows that share an id are each a
row, those with the smaller components first; with fewer than ENTRIES vectors, codebooks have an entry for each; null labels are one
label; further columns pass through unless `encode_vectors` adds one of that name, which it replaces; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Values of the products of a batch that are held at a time.
AT_ONCE = 4_000_000
_UNIT = 2.0**-24
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Codebooks(NamedTuple):
    """entries: by part, entry and position within the part."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Native: floor(scale * x) of all components; null for vectors that take no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fit, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x and c, pair by pair: in int64 where that holds them, else as integers of any size."""
    most = max(1, int(np.abs(x.astype(float)).max(initial=0)), int(np.abs(c.astype(float)).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 2**62:
        return ((x - c) ** 2).sum(axis=1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x the index of the nearest row of c, its exact squared distance, and how many distances were evaluated exactly."""
    n, d = x.shape
    wide, real = x.astype(np.float64), c.astype(np.float64)
    norm, own = (c.astype(object) ** 2).sum(axis=1).astype(np.float64), np.sqrt((real**2).sum(axis=1))
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
        rounding = (d + 2) * _UNIT / (1 - (d + 2) * _UNIT)
        # Rounding of these float64 steps themselves is covered by the factor and the share of 2^-48.
        error = 1.001 * (2 * rounding * np.sqrt((wide**2).sum(axis=1))[:, None] * own[None, :])
        middle = norm[None, :] - 2 * product
        error += 2.0**-48 * (norm[None, :] + 2 * np.abs(product)) + 1e-30
        low, high = middle - error, middle + error
        # Where float32 overflows nothing is known, so that entry stays.
        unknown = ~np.isfinite(low) | ~np.isfinite(high)
        low[unknown], high[unknown] = -np.inf, np.inf
        near = low <= high.min(axis=1)[:, None]
    row, col = np.nonzero(near)
    distance = _exact(x[row], c[col])
    # Of a row's entries, which are in order of index, the first with the least distance.
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if n else np.empty(0, int)
    least = np.minimum.reduceat(distance, start) if n else distance
    winner = np.flatnonzero(distance == least[row])
    winner = winner[np.unique(row[winner], return_index=True)[1]]
    return col[winner], distance[winner], len(row)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The integer vectors of a column, filled with zeros to dim components."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dim), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _assigned(batch: pa.RecordBatch, column: str, books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with their vectors by parts, the parts' entries and squared distances."""
    parts, entries, width = books.entries.shape
    step = max(1, AT_ONCE // max(1, parts * width, entries))
    for at in range(0, batch.num_rows, step):
        some = batch.slice(at, step)
        x = _matrix(some.column(column), parts * width).reshape(some.num_rows, parts, width)
        found = [nearest(x[:, p], books.entries[p])[:2] for p in range(parts)]
        yield some, x, np.stack([f[0] for f in found], axis=1), np.stack([f[1].astype(object) for f in found], axis=1)


def _sums(books: Codebooks, column: str):
    """(slot, position, total, count) of a task's parts, by the slots that they were assigned to."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, x, index, _ in _assigned(batch, column, books):
                slot = (index + np.arange(parts) * entries).ravel()
                rows = x.reshape(-1, width)
                count += np.bincount(slot, minlength=parts * entries)
                if len(rows) * float(np.abs(rows.astype(float)).max(initial=0)) < 2**52:  # sums of doubles are exact
                    for j in range(width):
                        total[:, j] += np.bincount(slot, rows[:, j], parts * entries).astype(np.int64)
                else:
                    np.add.at(total, slot, rows.astype(object))
        used = np.flatnonzero(count)
        slot, position = np.repeat(used, width), np.tile(np.arange(width), len(used))
        texts = pa.array([str(v) for v in total[used].ravel()], pa.string())
        yield pa.record_batch([pa.array(slot), pa.array(position), texts, pa.array(np.repeat(count[used], width))], ["slot", "position", "total", "count"])

    return run


def _moved(vectors: DataFrame, column: str, books: Codebooks) -> Codebooks:
    """books after a round: every used entry at the floor of its parts' mean."""
    partial = vectors.select(column).mapInArrow(_sums(books, column), "slot bigint, position bigint, total string, count bigint")
    summed = partial.groupBy("slot", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count"))
    entries = books.entries.copy()
    flat = entries.reshape(-1, entries.shape[2])
    for slot, position, total, count in summed.collect():  # no more than the codebooks have components
        flat[slot, position] = int(total) // count
    return Codebooks(entries)


def train(vectors: DataFrame, column: str = "v", id_col: str = "vec_id", rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks:
    """Codebooks of integer vectors (array<bigint>); none for an empty table."""
    longest = vectors.agg(F.max(F.size(column))).first()[0] or 0
    dim = -(-longest // parts) * parts
    first = vectors.select(id_col, column).orderBy(F.col(id_col).asc_nulls_last(), column).limit(entries).collect()
    start = np.zeros((len(first), dim), np.int64)
    for i, row in enumerate(first):
        start[i, : len(row[1])] = row[1]
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2)))
    for _ in range(rounds if books.entries.size else 0):
        books = _moved(vectors, column, books)
    return books


def _encode(books: Codebooks, column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, index, distance in _assigned(batch, column, books):
                codes = [bytes(row).hex() for row in index.astype(np.uint8)]
                error = np.clip(distance.sum(axis=1), _LEAST, _MOST).astype(np.int64) if some.num_rows else np.empty(0, np.int64)
                kept = [some.column(c) for c in names]
                yield pa.record_batch([*kept, pa.array(codes, pa.string()), pa.array(error)], [*names, "code", "error"])

    return run


def encode_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Codebooks]:
    """The rows of df that take part, with code (two hex digits for each part) and error (squared distance of vector and code), and the
    codebooks."""
    names = [c for c in df.columns if c not in ("code", "error")]
    column = fresh([*df.columns, "code", "error"], "integers")
    ready = df.select(*names, integers(F.col(vector_col)).alias(column)).filter(F.col(column).isNotNull())
    vectors = written(ready, "codes-vectors")
    books = train(vectors, column, id_col)
    if not books.entries.shape[1]:
        return vectors.drop(column).withColumns({"code": F.lit(""), "error": F.lit(0).cast("bigint")}), books
    schema = ", ".join([*(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names), "code string, error bigint"])
    return vectors.mapInArrow(_encode(books, column, names), schema), books


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error: error summed over the rows of a label. Sums are made before the shuffle, and a label's rows meet its sum in
    a join that Spark can split."""
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    held = F.least(wide, F.lit(int(_MOST)).cast("decimal(38,0)")).cast("bigint")
    label = fresh(coded.columns, "summed")
    sums = coded.groupBy(F.col(label_col).alias(label)).agg(held.alias("label_error"))
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col(label))).drop(label)


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    coded, books = encode_vectors(table)
    coded = written(coded.select("vec_id", "label", "code", "error"), "codes")
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_ASSIGN = """
{name}_d AS (
  SELECT r, p, e, sum((v - c) * (v - c))::BIGINT AS d FROM parts JOIN {books} USING (p, j) GROUP BY r, p, e),
{name} AS (SELECT r, p, e, d FROM {name}_d QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"""
_MOVE = """
{name} AS (
  SELECT b.p, b.e, b.j, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, j, (sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS c FROM parts JOIN {assigned} USING (r, p) GROUP BY p, e, j
  ) m USING (p, e, j))"""

OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM kept),
width AS (SELECT ceil(max(len(v)) / {PARTS}.0)::BIGINT AS w FROM rows),
cells AS (SELECT r, i, coalesce(v[i + 1], 0) AS v FROM rows, width, unnest(range(w * {PARTS})) AS t(i)),
parts AS (SELECT r, i // w AS p, i % w AS j, v FROM cells, width),
b0 AS (SELECT p, r AS e, j, v AS c FROM parts WHERE r < {ENTRIES}),
{_ASSIGN.format(name="a0", books="b0")},
{_MOVE.format(name="b1", books="b0", assigned="a0")},
{_ASSIGN.format(name="a1", books="b1")},
{_MOVE.format(name="b2", books="b1", assigned="a1")},
{_ASSIGN.format(name="a2", books="b2")},
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM rows JOIN coded USING (r), books
"""
