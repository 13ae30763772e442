"""Exact top-k search by inner product with the three-phase uniform threshold.

Vectors are cut into PARTS runs of components; a score is the sum of one partial score from each part's list. Candidates are
packed in blocks of BLOCK_ROWS rows by hash, queries in blocks of QUERY_ROWS; each pair of blocks is a task's unit of work.

1. Every block sends each query's k best entries of each part's list, with their totals. The k-th best total found is a bound: it
   is no more than the k-th best there is.
2. That bound goes to the query blocks. A candidate that reaches it must reach its share of the bound, the cutoff, in one part's list,
   and what it lacks there in the others. A part is no more than the product of its lengths, so after the first list is made, the
   next ones give only entries which can reach the bound with what is left; candidates too short for it are in no list.
3. Those have their scores resolved, part by part. All lists of a block are in one task, so 2 and 3 are one step, and only the k best
   of each query and block leave it. The k best of all remain, ties to the smaller id.

Blocks of candidates stay where they lie. Query blocks come to them by broadcast, in rounds of ROUND_BYTES at most.

Scores are of integers floor(1024 * component), exact to 64 bits; beyond they are held at the ends of the range.

Defined cases: vectors that are null or empty or hold a null or non-finite component, and rows with a null id, take no part;
vectors of different lengths are no candidates for each other; rows that share an id are each a candidate and a query, and the k best
of all queries of an id are its result; rows with a query's id are not its candidates; with fewer candidates than k all are
returned; very long vectors are split in parts like any other; other columns are left out, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SCALE, K, PARTS = 1024, 10, 4
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Queries of a block that meet its candidates at a time.
AT_ONCE = 128
#: Bytes of query vectors that are broadcast at a time.
ROUND_BYTES = 32_000_000
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "query_row bigint, part int, row bigint, partial bigint, total bigint"
SCORED = "query_id bigint, vec_id bigint, score bigint, copies bigint"


def _ready(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, copies, dim, row) of the vectors that take part: equal rows are one with their number, and row tells all apart."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    fit = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
    kept = fit.select(F.col(id_col).cast("bigint").alias("vec_id"), ints.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    return kept.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(dim, <name>, members): about `rows` vectors each."""
    per_dim = vectors.groupBy("dim").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.lit(1)).alias("blocks")).withColumnRenamed("dim", "d")
    dealt = vectors.join(per_dim, F.col("dim") == F.col("d")).withColumn(name, F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    return dealt.groupBy("dim", name).agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "copies", "v"))).alias("members"))


def _matrix(members: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and integer vectors of one block."""
    flat = members.flatten()
    rows, ids = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("row", "vec_id"))
    return rows, ids, flat.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _greatest(x: np.ndarray, y: np.ndarray) -> int:
    """No product of rows of x and y, nor a part of it, is beyond this."""
    most = [max(1, -int(v.min(initial=0)), int(v.max(initial=0))) for v in (x, y)]
    return x.shape[1] * most[0] * most[1]


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T: in float64 where all sums of products are exact in it, else in int64, else in integers of any size."""
    most = _greatest(x, y)
    if most < 2**53:
        return np.rint(x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x @ y.T if most < 2**62 else x.astype(object) @ y.T.astype(object)


def _held(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, _LEAST, _MOST).astype(np.int64) if scores.dtype == object else scores


def _cuts(dim: int) -> list[slice]:
    edge = np.linspace(0, dim, PARTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A batch, the row in it, some queries of that block (a slice), and rows, ids and vectors of these and of the candidates."""
    for batch in batches:
        for i in range(batch.num_rows):
            (qr, qi, q), (cr, ci, c) = _matrix(batch.column("queries").slice(i, 1)), _matrix(batch.column("members").slice(i, 1))
            for at in range(0, len(qi), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                yield batch, i, some, (qr[some], qi[some], q[some]), (cr, ci, c)


def _lengths(x: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """The length of each part of each row."""
    return np.stack([np.sqrt((x[:, s].astype(float) ** 2).sum(axis=1)) for s in cuts], axis=1)


def reaching(q: np.ndarray, c: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, column, score) of the products of rows of q and c that reach their row's bound (float, -inf for none), maybe with some
    that don't, and how many components were multiplied. Products have to be within 62 bits."""
    cuts = _cuts(q.shape[1])
    far, near = _lengths(q, cuts), _lengths(c, cuts)
    slack = 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0)) + 1
    # Of each part and those after it, the most that they can add.
    rest = [(far[:, k:] @ near[:, k:].T) * (1 + 1e-9) + 1 for k in range(len(cuts) + 1)]
    column = np.flatnonzero((rest[0] >= (bound - slack)[:, None]).any(axis=0))
    c, rest = c[column], [r[:, column] for r in rest]
    first = _product(q[:, cuts[0]], c[:, cuts[0]])
    work = first.size * (cuts[0].stop - cuts[0].start)
    row, col = np.nonzero(first * (1 + 1e-9 * np.sign(first)) + rest[1] >= (bound - slack)[:, None])
    score = first[row, col]
    for k in range(1, len(cuts)):
        part, dense = cuts[k], len(row) * 4 > len(q) * len(c)
        if dense:
            score = score + _product(q[:, part], c[:, part])[row, col]
        else:
            score = score + np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", q[row[at : at + 65536], part], c[col[at : at + 65536], part]) for at in range(0, len(row), 65536))])
        work += (len(q) * len(c) if dense else len(row)) * (part.stop - part.start)
        kept = score * (1 + 1e-9 * np.sign(score)) + rest[k + 1][row, col] >= (bound - slack)[row]
        row, col, score = row[kept], col[kept], score[kept]
    return row, column[col], score, work


_NONE = np.iinfo(np.int64).min


def _local_best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, (qr, qi, q), (cr, ci, c) in _pairs(batches):
            if _greatest(q, c) >= 2**62:
                continue  # what has no bound is resolved whole
            lists = [_product(q[:, s], c[:, s]) for s in _cuts(q.shape[1])]
            own = qi[:, None] == ci[None, :]
            for part, scores in enumerate(lists):
                held = np.where(own, _NONE, scores)
                best = np.argpartition(held, max(len(ci) - k, 0), axis=1)[:, -k:]
                row, col = np.repeat(np.arange(len(qi)), best.shape[1]), best.ravel()
                row, col = (x[held[row, col] != _NONE] for x in (row, col))
                total = sum(x[row, col] for x in lists)
                yield pa.record_batch([pa.array(qr[row]), pa.array(np.full(len(row), part, np.int32)), pa.array(cr[col]), pa.array(scores[row, col]), pa.array(total)], ["query_row", "part", "row", "partial", "total"])

    return run


def _resolved(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, some, (qr, qi, q), (cr, ci, c) in _pairs(batches):
            told = batch.column("bounds").slice(i, 1).flatten()
            bounds = dict(zip(told.field("query_row").to_pylist(), told.field("bound").to_pylist(), strict=True))
            if _greatest(q, c) < 2**62:
                row, col, score, _ = reaching(q, c, np.array([bounds.get(x, -np.inf) for x in qr.tolist()], float))
            else:
                row, col = np.nonzero(np.ones((len(qi), len(ci)), bool))
                score = _held(_product(q, c))[row, col]
            others = qi[row] != ci[col]
            row, col, score = row[others], col[others], score[others]
            # Of equal scores the smaller ids first, and no more than k.
            order = np.lexsort((ci[col], ~score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, score = row[nth < k], col[nth < k], score[nth < k]
            qn = batch.column("queries").slice(i, 1).flatten().field("copies").to_numpy(zero_copy_only=False)[some]
            cn = batch.column("members").slice(i, 1).flatten().field("copies").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(qi[row]), pa.array(ci[col]), pa.array(score), pa.array(qn[row] * cn[col])], ["query_id", "vec_id", "score", "copies"])

    return run


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each id where is_query (over the id column) holds."""
    vectors = written(_ready(df, id_col, vector_col), "topk-vectors")
    blocks = written(_blocks(vectors, BLOCK_ROWS, "block"), "topk-blocks")
    asked = vectors.withColumnRenamed("vec_id", id_col).filter(is_query).withColumnRenamed(id_col, "vec_id")
    queries = _blocks(asked, QUERY_ROWS, "qb").select(F.col("dim").alias("qdim"), "qb", F.col("members").alias("queries"))
    queries = written(queries, "topk-queries")
    size = queries.agg(F.sum(F.size("queries").cast("bigint") * (8 * F.col("qdim") + 32))).first()[0] or 0
    rounds = -(-size // ROUND_BYTES) or 1

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        made = [blocks.join(F.broadcast(asked.filter(F.pmod(F.xxhash64("qdim", "qb"), F.lit(rounds)) == r)), F.col("dim") == F.col("qdim")).drop("qdim").mapInArrow(run, schema) for r in range(rounds)]
        return reduce(DataFrame.unionByName, made)

    first = written(met(queries, _local_best(k), FOUND), "topk-local")
    best = W.partitionBy("query_row", "part").orderBy(F.desc("partial"), "row")
    seen = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("query_row", "row", "total").distinct()
    by_total = W.partitionBy("query_row").orderBy(F.desc("total"), "row")
    bounds = seen.withColumn("n", F.row_number().over(by_total)).filter(F.col("n") == k).select("query_row", F.col("total").alias("bound"))

    of_query = queries.select("qdim", "qb", F.explode("queries.row").alias("q")).join(bounds, F.col("q") == F.col("query_row"))
    of_block = of_query.groupBy(F.col("qdim").alias("bdim"), F.col("qb").alias("bqb")).agg(F.collect_list(F.struct("query_row", "bound")).alias("bounds"))
    told = queries.join(of_block, (F.col("qdim") == F.col("bdim")) & (F.col("qb") == F.col("bqb")), "left").drop("bdim", "bqb")
    told = told.withColumn("bounds", F.coalesce("bounds", F.array().cast("array<struct<query_row:bigint,bound:bigint>>")))
    told = written(told, "topk-told")
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    found = ranked(met(told, _resolved(k), SCORED))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("copies", F.lit(k).cast("bigint"))))
    return ranked(found.withColumn("copy", copies)).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
