"""Counts of findings over streams, by window of event time: what `review.tally` gives for a batch, with state that stays bounded.

A row is told by its id and time: repeats of both count once. Both the rows seen and the open windows are in the state store until the
watermark has passed them, so state grows with the rows within `delay`, not with the stream; a window is written once, when it closes.
After a restart the checkpoint goes on where it was, and no window is written twice.

Defined cases: a null text has no findings and counts as a document; a row without time takes no part; in a stream, times up to the start
of 1970 are late from the outset, as the watermark begins there; rows later than `delay`
may be dropped, and are once their window has been written; rows of one null id and one time count once; an empty stream writes
nothing; further columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import ScanOptions, scan

_PART = "struct<category:string,detector_id:string,findings:bigint,documents:bigint,without_findings:bigint>"


def _parts(findings: Column) -> Column:
    """Of one document: a part for each finding and rule, one for its category, and one for all."""

    def part(category: Column, rule: Column, n: Column, document: Column, without: Column) -> Column:
        return F.struct(category.alias("category"), rule.alias("detector_id"), n.alias("findings"), document.alias("documents"), without.alias("without_findings")).cast(_PART)

    none, one, zero = F.lit(None).cast("string"), F.lit(1), F.lit(0)
    whole = F.array(part(none, none, F.size(findings), one, (F.size(findings) == 0).cast("bigint")))
    by_rule = F.transform(findings, lambda f: part(f["category"], f["detector_id"], one, zero, zero))
    by_category = F.transform(findings, lambda f: part(f["category"], none, one, zero, zero))
    return F.concat(whole, by_category, by_rule)


def tally_windows(rows: DataFrame, window: str, delay: str, ts_col: str = "ts", id_col: str = "doc_id", text_col: str = "text", options: ScanOptions | None = None) -> DataFrame:
    """(start, category, detector_id, findings, documents, without_findings) of a stream or a batch: by window and rule, by category
    (detector_id is null) and in all (category is null too); the last two counts are 0 but on the rows for all."""
    own = rows.select(F.col(id_col).alias("id"), F.col(ts_col).alias("ts"), F.col(text_col).alias("text")).filter("ts IS NOT NULL")
    once_each = own.withWatermark("ts", delay).dropDuplicates(["id", "ts"])
    parts = scan(once_each, "text", options).select("ts", F.explode(_parts(F.col("findings"))).alias("p")).select("ts", "p.*")
    made = parts.groupBy(F.window("ts", window).alias("window"), "category", "detector_id").agg(*(F.sum(c).alias(c) for c in ("findings", "documents", "without_findings")))
    return made.select(F.col("window.start").alias("start"), "category", "detector_id", "findings", "documents", "without_findings")


def write_tally(stream: DataFrame, path: str, checkpoint: str, window: str, delay: str, **columns) -> StreamingQuery:
    """Writes the windows that close as Parquet, each once, and stops when what is there has been read."""
    made = tally_windows(stream, window, delay, **columns)
    return made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


__all__ = ["tally_windows", "write_tally"]
