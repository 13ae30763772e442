"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32 of the id, as text, leaves this remainder by 4 are held out of all learning.
HELD_OUT = 2


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most `rows` labelled ids that aren't held out: those of the least hashes.

    One row for each id, whatever repeats: of conflicting labels the greatest counts, of several texts the least."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("labelled")).agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("id", F.col("label").cast("int").alias("label"), "text")
    return found.groupBy("id", "label").agg(F.min("text").alias("text"))
