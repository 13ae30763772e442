"""Benchmark decontamination with native expressions: SimHash windows, multi-index Hamming blocks, exact verification.

A window has as many words as an item. Its weighted shingles are its 5-word runs with their number of occurrences, and its
similarity to the item is the sum of the smaller weights over the sum of the larger ones. Windows are made only where a
shingle of an item of that length starts: moving a window to the right up to the first such shingle loses no shingle that it
shares with the item, so no similarity is lost by leaving the others out.

A window's fingerprint has 64 bits: each is set where more than half of the shingle hashes have it. It is cut into BLOCKS
blocks; two fingerprints within RADIUS agree in one block up to RADIUS // BLOCKS bits, so items are filed under every block
value within that, and one equality join finds all pairs within the radius. Pairs at the threshold of 0.75 lie some 11 bits
apart. Those found are verified on the shingles themselves.

The item tables are broadcast only while they have at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes; beyond that the joins
shuffle.

Defined cases: words are lower-cased; null and empty texts and items match nothing; an item of fewer than five words is one
shingle; rows with one id and text are reported once, also where the id is null; of windows that are alike the first counts; very long
texts are read whole, and the work on them grows with their length times that of the items they share shingles with; other columns
are left out, or by drop_contaminated kept, whatever their names; empty tables give an empty table.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, word_list, written

SHINGLE, PERCENT = 5, 75
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000
#: All changes of up to RADIUS // BLOCKS bits of a block.
CHANGES = sorted(sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n))


def _small(df: DataFrame, size: Column) -> bool:
    """Whether df is small enough to be broadcast. size: of each row, in bytes."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def _checked(df: DataFrame, size: Column) -> DataFrame:
    """df to be broadcast, if it is small enough."""
    return F.broadcast(df) if _small(df, size) else df


def _once(value: Column) -> Column:
    """value as a generated column, so that no later filter or lambda computes it again."""
    return F.explode(F.array(value))


def _hashes(words: Column, k: int) -> Column:
    """The hash of every k-word run."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))


def fingerprint(hashes: Column, planes: int) -> Column:
    """The majority of each bit. Counts are kept by bit planes: plane j holds bit j of all 64 counts; needs size < 2**planes."""
    names = [f"p{j}" for j in range(planes)]

    def add(counts: Column, h: Column) -> Column:
        carry, out = h, []
        for name in names:
            plane = counts[name]
            out.append(plane.bitwiseXOR(carry).alias(name))
            carry = plane.bitwiseAND(carry)
        return F.struct(*out)

    def majority(counts: Column) -> Column:
        half = F.floor(F.size(hashes) / 2)
        more, equal = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
        for j in reversed(range(planes)):
            bit = -F.shiftright(half, j).bitwiseAND(F.lit(1))
            plane = counts[names[j]]
            more = more.bitwiseOR(equal.bitwiseAND(plane).bitwiseAND(F.bitwise_not(bit)))
            equal = equal.bitwiseAND(F.bitwise_not(plane.bitwiseXOR(bit)))
        return more

    return F.aggregate(hashes, F.struct(*(F.lit(0).cast("bigint").alias(n) for n in names)), add, majority)


def _block(value: Column, b: int) -> Column:
    return F.shiftrightunsigned(value, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _common_weight(x: Column, y: Column) -> Column:
    """The sum of the smaller number of occurrences, over the distinct members."""
    times = lambda a, v: F.size(F.filter(a, lambda u: u == v))
    plain = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    return F.when(plain(x) | plain(y), F.size(F.array_intersect(x, y))).otherwise(F.aggregate(F.array_distinct(x), F.lit(0), lambda total, v: total + F.least(times(x, v), times(y, v))))


def _of_size(docs: DataFrame, items: DataFrame, k: int, planes: int) -> DataFrame:
    """Matches of the items whose shingles have k words: (id, text_key, item_id, start, words, similarity)."""
    hashed = items.select("item_id", "n", "words", _hashes(F.col("words"), k).alias("hashes"))
    anchors = hashed.select("n", F.explode("hashes").alias("anchor")).distinct()
    narrow = _small(anchors, F.lit(12))
    anchors = F.broadcast(anchors) if narrow else anchors
    runs = docs.select("id", "text_key", "words", F.posexplode(_hashes(F.col("words"), k)).alias("start", "hash"))
    if narrow:  # the words of a text stay where they are, and only windows leave the scan
        found = runs.join(anchors, F.col("hash") == F.col("anchor"))
    else:
        hits = runs.select("id", "text_key", "start", "hash").join(anchors, F.col("hash") == F.col("anchor")).select("id", "text_key", "start", "n")
        there = docs.select(F.col("id").alias("i"), F.col("text_key").alias("t"), "words").dropDuplicates(["i", "t"])
        found = hits.join(there, (F.col("text_key") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")))
    windows = found.select("id", "text_key", "start", "n", F.slice("words", F.col("start") + 1, F.col("n")).alias("window"))
    windows = windows.select("*", _hashes(F.col("window"), k).alias("hashes"))
    windows = windows.select("id", "text_key", "start", "n", "window", _once(fingerprint(F.col("hashes"), planes)).alias("print"))

    printed = hashed.select("item_id", F.xxhash64("item_id", F.array_join("words", " ")).alias("item_key"), "n", F.col("words").alias("item"), fingerprint(F.col("hashes"), planes).alias("item_print"))
    filed = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("item_print"), b).alias("value")) for b in range(BLOCKS))))
    change = F.explode(F.array(*map(F.lit, CHANGES))).alias("change")
    filed = printed.select(F.col("item_key").alias("filed_key"), F.col("n").alias("m"), "item_print", filed.alias("at")).select("*", change)
    filed = _checked(filed.select("filed_key", "m", "item_print", F.col("at.block").alias("b"), F.col("at.value").bitwiseXOR(F.col("change")).alias("v")), F.lit(32))

    looked = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("print"), b).alias("value")) for b in range(BLOCKS))))
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*(F.when(F.bit_count(_block(apart, b)) <= RADIUS // BLOCKS, b) for b in range(BLOCKS)))
    near = windows.select("*", looked.alias("at")).join(filed, (F.col("n") == F.col("m")) & (F.col("at.block") == F.col("b")) & (F.col("at.value") == F.col("v")))
    near = near.filter((F.bit_count(apart) <= RADIUS) & (first == F.col("b"))).select("id", "text_key", "start", "window", "filed_key")

    exact = near.join(_checked(printed.select("item_id", "item_key", "item"), F.octet_length(F.array_join("item", " ")) + 16 * F.size("item")), F.col("filed_key") == F.col("item_key"))
    exact = exact.select("*", _once(F.struct(_shingles(F.col("window"), k).alias("x"), _shingles(F.col("item"), k).alias("y"))).alias("s")).select("*", "s.x", "s.y")
    exact = exact.select("id", "text_key", "item_id", "start", F.size("window").alias("words"), _common_weight(F.col("x"), F.col("y")).alias("common"), (F.size("x") + F.size("y")).alias("both"))
    exact = exact.filter(100 * F.col("common") >= PERCENT * (F.col("both") - F.col("common")))
    return exact.select("id", "text_key", "item_id", "start", "words", (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity"))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, text_key, item_id, similarity, start, words): the best window (start and length in words) of each text and item that match."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), word_list(F.lower(text_col)).alias("words"))
    items = benchmark.select(F.col(item_id_col).alias("item_id"), word_list(F.lower(item_text_col)).alias("words"))
    items = items.select("item_id", "words", F.size("words").alias("n")).filter("n > 0").distinct()
    items = written(items, "benchmark-items")
    sizes = items.select(F.least("n", F.lit(SHINGLE)).alias("k"), "n").groupBy("k").agg(F.max("n").alias("most")).collect()
    found = None
    for k, most in sorted(tuple(r) for r in sizes):
        own = items.filter(F.least("n", F.lit(SHINGLE)) == k)
        part = _of_size(docs, own, k, planes=max(most - k + 1, 1).bit_length())
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.limit(0).select("id", "text_key", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit(0.0).alias("similarity"))
    best = F.max_by(F.struct("similarity", "start", "words"), F.struct("similarity", -F.col("start"))).alias("best")
    return found.groupBy("id", "text_key", "item_id").agg(best).select("id", "text_key", "item_id", "best.similarity", "best.start", "best.words")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that match no item."""
    key = fresh(df.columns, "text_key")
    found = contaminated(df, benchmark, id_col, text_col).select(F.struct("id", "text_key").alias("found")).distinct()
    keyed = df.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key")))
    there = fresh(keyed.columns, "found")
    found = found.withColumnRenamed("found", there)
    return keyed.join(found, keyed[key].eqNullSafe(found[there]), "left_anti").drop(key)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, benchmark).select(F.col("id").alias("doc_id"), "item_id", "similarity", "start", "words")
