"""What several operators share: words and hashes of whole Arrow batches, and tables in the shared folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACE_BYTES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240901).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Multipliers of a word by its place in a run of words.
PLACE = np.random.default_rng(7).integers(1, 2**63, 128, dtype=np.uint64) | np.uint64(1)
#: Bytes of text handled at a time in a Python worker.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder on a local master,
    whose executors are the driver itself; on a cluster that is an error, as no other folder is known to be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkveil-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes when the session's driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: later reads need nothing of its lineage."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of more than this share of all rows, and of HOT_ROWS rows at least, are joined by broadcast: there can be few of them.
HOT_SHARE, HOT_ROWS = 1 / 50_000, 1000


def joined_by_key(rows: DataFrame, keys: DataFrame, key: str, own: str, members: str, total: int) -> DataFrame:
    """rows with the columns of keys, one for each key (column `own`) with its number of rows (column `members`), of `total` in all.

    Rows of a hot key stay where they are and meet a broadcast table of the hot keys, of which there are at most 1 / HOT_SHARE."""
    hot = F.col(members) > max(HOT_ROWS, int(total * HOT_SHARE))
    few, same = F.broadcast(keys.filter(hot)), F.col(key) == F.col(own)
    return rows.join(few, same).unionByName(rows.join(few.select(own), same, "left_anti").join(keys.filter(~hot), same))


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_list(text: Column | str) -> Column:
    """Native: the words of a text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    """Native: the number of words, without making them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, size, 2**64))])
    return _powers[0], _powers[1]


class Words:
    """The words of some texts: `joined` has them all, one space after each; word i is joined[start[i]:end[i]], and text t has the words first[t]:first[t + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False, inside: np.ndarray = _IS_WORD):
        """inside: of each byte, whether it belongs to words."""
        ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), b""), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        _, offsets, data = ended.buffers()
        at = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if len(ended) else np.empty(0, np.uint8)
        inside = inside[raw]
        kept = inside.copy()
        kept[1:] |= inside[:-1]
        self.joined = (_LOWER[raw] if lower else raw)[kept]
        self.joined[~inside[kept]] = 32
        self.end = np.flatnonzero(~inside[kept])
        self.start = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64) if len(self.end) else np.empty(0, np.int64)
        ends = np.flatnonzero(kept & ~inside)
        self.first = np.searchsorted(ends, at - at[0])
        self.first[-1] = len(self.end)

    def hashes(self, head: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `head` bytes."""
        n = len(self.joined)
        end = self.end if head is None else np.minimum(self.end, self.start + head)
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.joined] * power[:n], out=total[1:])
        return mix((total[end] - total[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))


    def digests(self) -> np.ndarray:
        """64 bits of a cryptographic hash of each word: texts can't be made so that different words meet. Slower than hashes."""
        n = len(self.end)
        if not n:
            return np.empty(0, np.uint64)
        offsets = np.concatenate([[0], self.end + 1]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(self.joined)]).dictionary_encode()
        known = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in coded.dictionary.to_pylist()), np.uint64)
        return known[coded.indices.to_numpy()]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, over the bounds of texts too: as many as words, the last k - 1 of no meaning."""
    total = words * PLACE[0]
    for j in range(1, min(k, len(words))):
        total[: len(words) - j] += words[j:] * PLACE[j]
    return mix(total)


def pieces(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """batch in slices of about CHUNK_BYTES of text."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        until = int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, "right"))
        until = min(max(until, at + 1), batch.num_rows)
        yield batch.slice(at, until - at)
        at = until
