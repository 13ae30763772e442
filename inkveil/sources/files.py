"""Text files: validation, decoding, export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 2 * 1024 * 1024
#: Bytes looked at for NULs where there is no byte order mark.
PROBE_BYTES = 4096
EXTENSIONS = (
    "txt", "log", "md", "text", "out", "err", "json", "jsonl", "csv", "tsv", "xml", "yml", "yaml", "toml", "ini", "conf", "cfg", "config", "env", "properties",
    "ps1", "psm1", "psd1", "sh", "bash", "bat", "cmd", "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "cs", "java", "go", "rs", "rb", "php", "sql", "c", "h", "cpp", "html", "css",
)


def import_problem(path: Column, length: Column, mime: Column | None = None) -> Column:
    """Why a file isn't taken, or null: too large, or neither text/* nor of a known extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    text = F.coalesce((mime if mime is not None else F.lit("")).startswith("text/"), F.lit(False))
    return F.when(length > MAX_BYTES, F.lit("too large")).when(~text & ~extension.isin(*EXTENSIONS), F.lit("unsupported type"))


def decode(raw: bytes | None) -> str | None:
    """By byte order mark; else UTF-16LE if over a quarter of the first bytes are NUL; else UTF-8. Bad sequences are replaced."""
    if raw is None:
        return None
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(encoding, "replace")
    head = raw[:PROBE_BYTES]
    return raw.decode("utf-16-le" if head and head.count(0) > len(head) / 4 else "utf-8", "replace")


def _plain(content: Column) -> Column:
    """The text of bytes that have no UTF-16 mark, few NULs and are valid UTF-8, natively; null for others."""
    head = F.substring(content, 1, PROBE_BYTES)
    bytes_ = F.decode(head, "ISO-8859-1")  # a character for each byte
    nuls = F.length(bytes_) - F.length(F.replace(bytes_, F.lit("\u0000"), F.lit("")))
    wide = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    body = F.when(marked, F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    return F.when(~wide & (marked | (nuls <= F.octet_length(head) / 4)), F.try_validate_utf8(body.cast("string")))


def with_text(files: DataFrame, content_col: str = "content") -> DataFrame:
    """files with text. Valid UTF-8 is decoded natively; Python workers see only what isn't, as bytes that are decoded with
    replacements, in Arrow batches."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(decode)

    plain, rest = fresh_name(files.columns, "plain"), fresh_name(files.columns, "rest")
    out = files.withColumn(plain, _plain(F.col(content_col)))
    out = out.withColumn(rest, F.when(F.col(plain).isNull(), F.col(content_col)))
    return out.withColumn("text", F.coalesce(F.col(plain), decoded(F.col(rest)))).drop(plain, rest)


def fresh_name(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, problem, text) of the files under path; text is null where there is a problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.withColumn("problem", import_problem(F.col("path"), F.col("length")))
    return with_text(files.withColumn("content", F.when(F.col("problem").isNull(), F.col("content")))).select("path", "length", "problem", "text")
