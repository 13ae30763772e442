"""Mixing of sources to target weights by the cube method.

Sources, in code point order with null last, get the weights in turn, and share `share` times all words; no target exceeds
`cap` times its source's words, and what is above is shared again by weight (in one pass: sources sorted by cap over weight
are full up to the first that the level reached doesn't fill). Every document of a source is expected target / source words
times; it is taken the whole part of that, and once more with the fractional part as inclusion probability.

Which documents get that one more is balanced sampling: a flight moves the probabilities of three documents along the null
space of two constraints (number of documents, number of words) until one of them is 0 or 1, and goes on with the next. It
runs in blocks of a source, by hash, so that a large source is many tasks; each leaves two documents at most, and these fly
again in fewer blocks. Where a source is one block, the last two land on the outcome nearest to the expected words.

Defined cases: a null or empty text has size 0 and takes 0; rows that agree in id, text and source are first counted as one
unit of that multiplicity, so a much repeated row is no large group; the choice depends on the rows alone, so reruns agree;
documents that tie in size and chance are told apart by hash; a very long text is one document, and a source's words come within one
document of the target; a null source is a source; an empty table gives an empty table; columns named as an added one are replaced.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Units that fly in one block, on average.
BLOCK_UNITS = 20_000
_EPS = 1e-9
UNIT = "id string, text_key bigint, source string, size bigint, rows bigint, sure bigint, chance double, left long"


def _with_sums_before(df: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """df with, for each column of sums, before_<column>: its sum over all rows that come earlier in the order.

    The rows are cut into ranges of the order; only the sums of the ranges, one row each, are added up in one task."""
    ranged = written(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    of_range = ranged.groupBy("range").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = of_range.select("range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"offset_{c}") for c in sums))
    inside = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"inside_{c}") for c in sums))
    joined = summed.join(F.broadcast(offsets), "range")
    return joined.select(*df.columns, *((F.col(f"offset_{c}") + F.col(f"inside_{c}")).alias(f"before_{c}") for c in sums))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with target. Sources may be as many as rows: none of the steps takes them all in one task."""
    listed = F.array(*(F.lit(float(w)) for w in weights))
    by_name = F.col("source").asc_nulls_last()
    placed = _with_sums_before(sizes.withColumn("one", F.lit(1)), [by_name], ["one"], "mix-names")
    weight = F.element_at(listed, (F.pmod(F.col("before_one"), F.lit(len(weights))) + 1).cast("int"))
    rated = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    filled = _with_sums_before(rated.withColumn("fill", F.col("most") / F.col("weight")), [F.col("fill").asc(), by_name], ["most", "weight"], "mix-fills")
    whole = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    level = (F.lit(float(whole["words"] or 0) * float(share)) - F.col("before_most")) / (F.lit(float(whole["weights"] or 0)) - F.col("before_weight"))
    first_open = filled.withColumn("level", level).filter("level <= fill").agg(F.min(F.struct("fill", F.col("source").isNull(), "source", "level"))["level"]).first()[0]
    target = F.col("most") if first_open is None else F.least("most", F.lit(first_open) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def fly(sizes: list[int], chances: list[float], dice: random.Random) -> list[float]:
    """The chances after a flight: all but two at most are 0 or 1, and both totals are as before."""
    out = list(chances)
    held: list[int] = []
    for i in [*range(len(out)), None]:
        if i is not None:
            if _EPS < out[i] < 1 - _EPS:
                held.append(i)
            if len(held) < 3:
                continue
        while len(held) == 3 or len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
            if len(held) == 3:
                x, y, z = (sizes[j] for j in held)
                move = (z - y, x - z, y - x) if not x == y == z else (1, -1, 0)
            else:
                move = (1, -1)
            up = min((1 - out[j]) / m if m > 0 else out[j] / -m for j, m in zip(held, move, strict=True) if m)
            down = min(out[j] / m if m > 0 else (1 - out[j]) / -m for j, m in zip(held, move, strict=True) if m)
            step = up if dice.random() * (up + down) < down else -down
            for j, m in zip(held, move, strict=True):
                out[j] += step * m
                if out[j] < _EPS or out[j] > 1 - _EPS:
                    out[j] = float(out[j] > 0.5)
            held = [j for j in held if 0 < out[j] < 1]
            if i is not None:
                break
    return out


def land(sizes: list[int], chances: list[float]) -> list[float]:
    """The last few get 0 or 1: the outcome whose words are nearest to the expected."""
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    if not open_:
        return chances
    meant = sum(sizes[i] * chances[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda o: (abs(sum(sizes[i] for b, i in enumerate(open_) if o >> b & 1) - meant), o))
    out = list(chances)
    for b, i in enumerate(open_):
        out[i] = float(best >> b & 1)
    return out


def _flight(last: bool):
    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["order", "text_key", "size", "rows"], kind="stable")
        first = units.iloc[0]
        dice = random.Random(f"{first['order']} {first['text_key']} {len(units)}")
        sizes, chances = units["size"].tolist(), units["chance"].tolist()
        chances = fly(sizes, chances, dice)
        if last or bool(first["alone"]):
            chances = land(sizes, chances)
        units["left"] = [int(0 < p < 1) for p in chances]
        units["sure"] = units["sure"] + [int(p >= 1) for p in chances]
        units["chance"] = [p if 0 < p < 1 else 0.0 for p in chances]
        return units[["id", "text_key", "source", "size", "rows", "sure", "chance", "left"]]

    return run


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """A row for each row of df: id, text_key, source, size, source_size, target, taken (words) and copies."""
    text_key = F.xxhash64(text_col)
    slim = df.select(F.col(id_col).alias("id"), text_key.alias("text_key"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    id_type = slim.schema["id"].dataType.simpleString()
    units = written(slim.groupBy("id", "text_key", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units"))
    wanted = targets(sizes.drop("units"), weights, share, cap)
    stats = written(wanted.join(sizes.select(F.col("source").alias("s"), "units"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "units"), "mix-targets")

    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    meant = F.col("rows") * per_row
    whole = F.floor(meant + _EPS)
    planned = units.join(stats, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").cast("string").alias("id"), "text_key", "source", "size", "rows", whole.alias("sure"),
        F.greatest(meant - whole, F.lit(0.0)).alias("chance"), F.greatest(F.ceil(F.col("units") / BLOCK_UNITS), F.lit(1)).alias("blocks"),
    )
    planned = planned.withColumn("chance", F.when((F.col("size") > 0) & (F.col("chance") > _EPS), F.col("chance")).otherwise(F.lit(0.0)))
    flying = planned.filter("chance > 0")
    done = planned.filter("chance = 0").select("id", "text_key", "source", "size", "rows", "sure")
    level = 0
    while True:
        order = F.xxhash64("id", "text_key", F.lit(level))
        dealt = flying.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64("order"), F.col("blocks"))).withColumn("alone", F.col("blocks") == 1).drop("blocks")
        flown = written(dealt.groupBy("source", "block").applyInPandas(_flight(False), UNIT), f"mix-flight{level}")
        done = done.unionByName(flown.filter(F.col("left") == 0).select("id", "text_key", "source", "size", "rows", "sure"))
        rest = flown.filter(F.col("left") == 1)
        if rest.isEmpty():
            break
        of_source = rest.groupBy("source").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_UNITS), F.lit(1)).alias("blocks")).withColumnRenamed("source", "s")
        flying = rest.join(of_source, F.col("source").eqNullSafe(F.col("s"))).select("id", "text_key", "source", "size", "rows", "sure", "chance", "blocks")
        level += 1
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))
    rows = done.withColumn("nth", each)
    copies = F.floor(F.col("sure") / F.col("rows")) + F.when(F.col("nth") <= F.pmod(F.col("sure"), F.col("rows")), 1).otherwise(0)
    result = rows.withColumn("copies", copies).join(stats.drop("units"), F.col("source").eqNullSafe(F.col("s")))
    return result.select(F.col("id").cast(id_type).alias("id"), "text_key", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), F.col("copies").cast("bigint").alias("copies"))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")
