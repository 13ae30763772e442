"""Sanitising streams: scanning keeps no state between rows, so the batch transform runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.render import sanitize
from ..operators.scan import ScanOptions, scan


def sanitized_stream(stream: DataFrame, text_col: str = "text", options: ScanOptions | None = None) -> DataFrame:
    return sanitize(scan(stream, text_col, options), text_col)


def write_sanitized(stream: DataFrame, path: str, checkpoint: str, text_col: str = "text", options: ScanOptions | None = None) -> StreamingQuery:
    """Writes rows with their text replaced, each exactly once, and stops when what is there has been read."""
    out = sanitized_stream(stream, text_col, options)
    out = out.select(*(F.col("clean_text").alias(c) if c == text_col else F.col(c) for c in stream.columns))
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
