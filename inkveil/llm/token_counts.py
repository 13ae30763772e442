"""Token counts of whole texts under a byte-level BPE vocabulary, with huge texts cut into overlapping chunks.

A text of more than `chunk_chars` bytes is cut into chunks of so many characters, each overlapping the next by `overlap`.
Every chunk is a row of its own, so one text is spread over many tasks. A chunk is encoded with offsets, and reports at
which characters of its overlaps a pre-token begins and how many tokens lie before. Two neighbours are spliced at a
character where a pre-token begins in both: the pre-tokeniser scans from left to right and keeps nothing from before a
boundary, so from there on both read alike. Boundaries too near a chunk's end, which missing text could move, don't count.
If neighbours share no such boundary, the whole text is cut again with chunks and overlaps four times as wide, until it fits
or is one chunk.

Defined cases: null and empty texts have no tokens; strings of special tokens within a text are one token each, as the
library does by default; repeated rows are counted alike, also where the id is null; other columns are passed on, whatever their
names, and one named n_tokens is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

CHUNK_CHARS, OVERLAP = 40_000, 2_000
TOKEN_LIMIT = 512
#: Pre-tokens at a chunk's end whose beginnings don't count.
UNSURE = 3
_loaded: dict[str, object] = {}


def _tokenizer(spec: str):
    """One tokenizer for each worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[key] = Tokenizer.from_str(spec)
    return _loaded[key]


def _boundaries(encoding) -> list[tuple[int, int]]:
    """(first character, tokens before) of every pre-token or special token."""
    out, last = [], object()
    for i, (word, span) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word is None or word != last:
            out.append((span[0], i))
        last = word
    return out


def splice(chunks: list[dict]) -> int | None:
    """Tokens of a text from its chunks in order; None if two neighbours share no boundary."""
    total, before = 0, 0
    for left, right in zip(chunks, chunks[1:], strict=False):
        there = dict(zip(right["head_at"], right["head_n"], strict=True))
        common = next(((n, there[p]) for p, n in zip(reversed(left["tail_at"]), reversed(left["tail_n"]), strict=True) if p in there), None)
        if common is None or common[0] < before:
            return None
        total += common[0] - before
        before = common[1]
    return total + chunks[-1]["n"] - before


CHUNK = "struct<k: bigint, n: bigint, head_at: array<bigint>, head_n: array<bigint>, tail_at: array<bigint>, tail_n: array<bigint>>"


def _big_counts(texts: DataFrame, spec, chunk_chars: int, overlap: int) -> DataFrame:
    """(id, text_key, n) of each text; n is null where a splice failed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                key = batch.column("key").slice(i, 1)
                step = chunk_chars - overlap
                starts = range(0, max(len(text) - overlap, 1), step)
                for k in starts:
                    yield pa.record_batch([key, pa.array([k // step]), pa.array([k]), pa.array([k + chunk_chars >= len(text)]), pa.array([text[k : k + chunk_chars]])], ["key", "k", "start", "last", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        longest = max([len(t.content) for t in tokenizer.get_added_tokens_decoder().values()], default=0)
        for batch in batches:
            rows = []
            for k, start, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("k", "start", "last", "chunk")), strict=True):
                encoding = tokenizer.encode(chunk, add_special_tokens=False)
                marks = [(start + p, n) for p, n in _boundaries(encoding)]
                sure = marks[:-UNSURE]
                head = [m for m in marks if m[0] < start + overlap] if k else []
                tail = [m for m in sure if start + chunk_chars - overlap <= m[0] < start + chunk_chars - longest] if not last else []
                rows.append({"k": k, "n": len(encoding), "head_at": [m[0] for m in head], "head_n": [m[1] for m in head], "tail_at": [m[0] for m in tail], "tail_n": [m[1] for m in tail]})
            kind = pa.struct([("k", pa.int64()), ("n", pa.int64())] + [(c, pa.list_(pa.int64())) for c in ("head_at", "head_n", "tail_at", "tail_n")])
            yield pa.record_batch([batch.column("key"), pa.array(rows, kind)], ["key", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("key"), pa.array([splice(parts) for parts in batch.column("parts").to_pylist()], pa.int64())], ["key", "n"])

    key = texts.schema["key"].dataType.simpleString()
    chunks = texts.mapInArrow(cut, f"key {key}, k bigint, start bigint, last boolean, chunk string").repartition(F.col("key"), F.col("k"))
    parts = chunks.mapInArrow(encode, f"key {key}, part {CHUNK}")
    return parts.groupBy("key").agg(F.sort_array(F.collect_set("part")).alias("parts")).mapInArrow(join, f"key {key}, n bigint")


def count_tokens(df: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, keep_text: bool = True) -> DataFrame:
    """df with n_tokens, for a vocabulary file of the library tokenizers. Without keep_text, the text column is left out."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    passed = [c for c in df.columns if c != "n_tokens" and (keep_text or c != text_col)]
    text = fresh(passed, "whole_text")
    large = F.coalesce(F.octet_length(text_col), F.lit(0)) > chunk_chars

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec.value)
        for batch in batches:
            n = [len(e) for at in range(0, batch.num_rows, 256) for e in tokenizer.encode_batch_fast([t or "" for t in batch.column(text)[at : at + 256].to_pylist()], add_special_tokens=False)]
            yield pa.record_batch([batch.column(c) for c in passed] + [pa.array(n, pa.int64())], [*passed, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(passed).schema)
    small = df.filter(~large).withColumn(text, F.col(text_col)).select(*passed, text).mapInArrow(count, f"{fields}, n_tokens bigint")

    big = df.filter(large)
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    texts = big.select(key.alias("key"), F.col(text_col).alias("text"))
    counts = written(_big_counts(texts, spec, chunk_chars, overlap), "token-counts")
    done, todo = counts.filter("n is not null"), counts.filter("n is null").select("key")
    while not todo.isEmpty():
        chunk_chars, overlap = 4 * chunk_chars, 4 * overlap
        again = written(_big_counts(texts.join(todo, "key", "left_semi"), spec, chunk_chars, overlap), "token-counts")
        done, todo = done.unionByName(again.filter("n is not null")), again.filter("n is null").select("key")
    of_key = fresh(passed, "big_key")
    done = done.select(F.col("key").alias(f"_{of_key}"), F.col("n").alias("n_tokens"))
    counted = big.drop("n_tokens").withColumn(of_key, key).join(done, F.col(of_key).eqNullSafe(F.col(f"_{of_key}")), "left")
    return small.unionByName(counted.select(*passed, "n_tokens"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
