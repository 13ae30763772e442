"""A corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Quality: documents that the classifier rejects go. Near-dedup: one document of each component stays. Substring dedup: repeated
passages are cut out; a document of which nothing is left goes, others keep their text as it was if nothing was removed.
Decontamination: documents with a benchmark passage go. Mixing: documents are repeated or left out so that sources meet their
targets; column `copy` tells copies apart.

Defined cases, of every stage: a null or empty text has no words, and such rows stay, though the mix takes none of what has no size;
rows whose ids repeat or are null are rows of their own, and only copies and near copies go; of rows that tie the least stays, so
that reruns agree; very long texts are read whole; an empty table, benchmark or list of labels gives stages that drop nothing for
lack of it; further columns pass through, whatever their names, and if `copy` is taken that column is `_copy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import decontaminate, mixing, near_dup, quality, substring_dedup
from inkveil.llm.common import fresh, work_path

#: Documents with a lower probability of being good are rejected: half the odds, so that doubtful ones stay.
REJECT_BELOW = 0.5


def _apart(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that an operator would replace under other names, and how to name them back."""
    moved = {c: fresh([*docs.columns, *added], c) for c in docs.columns if c.lower() in added}
    return docs.withColumnsRenamed(moved), {new: old for old, new in moved.items()}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = _apart(docs, "score")
    return quality.score_quality(own, model).filter(F.col("score") >= REJECT_BELOW).select(own.columns).withColumnsRenamed(back)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row: with the smallest id, null last, of these the least text hash, and of copies the least row.

    Rows without words are each a component and all stay."""
    names, (docs, back) = docs.columns, _apart(docs, "n_shingles", "component_id", "kept")
    chosen = fresh(docs.columns, "chosen")
    found = near_dup.near_components(docs, chosen=chosen).filter(chosen)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    known = found.filter("n_shingles > 0").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias(chosen)).select("doc_id", "text", f"{chosen}.*")
    made = known.select(docs.columns).unionByName(found.filter("n_shingles = 0").select(docs.columns))
    return made.withColumnsRenamed(back).select(names)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, (docs, back) = docs.columns, _apart(docs, "n_words", "n_removed", "kept_text")
    cut = substring_dedup.dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns).withColumnsRenamed(back).select(names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, twice at most, and copy from 1.

    Rows are told apart by all their columns, so only rows that are equal in everything stand for each other."""
    key, same, number = (fresh(docs.columns, n) for n in ("row_key", "mixed_key", "times"))
    keyed = docs.withColumn(key, F.base64(F.unhex(F.sha2(F.to_json(F.struct(*docs.columns)), 256))))
    taken = mixing.mix_sources(keyed.select(F.col(key), "text", "source"), id_col=key).filter("copies > 0 AND size > 0").select(F.col("id").alias(same), F.col("copies").alias(number))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(number))).alias(fresh(docs.columns, "copy"))
    return keyed.dropDuplicates([key]).join(taken, F.col(key) == F.col(same)).select(*docs.columns, copies)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = work_path(spark, "corpus")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{root}/{name}")
    return docs
