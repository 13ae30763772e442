"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact confirmation, components.

1. A text's set is its distinct shingles. Texts of equal sets are one class, so copies are never compared.
2. Signatures of HASHES minima are banded; classes that share a band are candidates. With 32 bands of 4, a pair at the
   threshold of 0.75 shares none with a probability of 5e-6.
3. Candidates are taken from each bucket in two rounds: first all members against one centre, which links a group of near
   copies with as many pairs as members. Buckets whose members are by then in one component are done. In the others, members of
   different components are compared.
4. Pairs are compared by batches of hashes. After n hashes with m equal, the posterior of the similarity under a flat prior is
   Beta(m + 1, n - m + 1); a pair is pruned as soon as the chance of the threshold or more is below MISS. The first round compares
   signatures, the second one sketches: SKETCH further minima of a byte each, made only of the members that are left. They tell 0.75
   from 0.65, so texts that share a template and no more are pruned with nearly no text read.
5. Survivors are confirmed on their full sets: 100 * intersection >= 75 * union.

In the second round, buckets of up to PAIRED members make a row for each pair. Larger ones are cut in blocks of BLOCK members: those
outside the bucket's main component meet all, and only sketches travel, once for each block that they meet. A pair of blocks with
survivors is one row, which gets their texts. No step makes rows for all pairs of a group.

Words count by a cryptographic hash of theirs. Defined cases: null and empty texts have an empty set, link with nothing and are kept; a
text of fewer words than a shingle is one shingle; very long texts are read whole, and so are long words; a null id counts as larger
than all others; rows with one id are kept or dropped together; an empty table gives an empty table; other columns are passed on, and
columns named as an added one are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, Words, fresh, joined_by_key, mix, pieces, run_hashes, written
from .components import components

SHINGLE = 5
HASHES, BAND_ROWS, BATCH = 128, 4, 32
#: Similarity in hundredths.
PERCENT = 75
MISS = 1e-6
PAIRED, BLOCK = 12, 512
#: Hashes of a sketch, and how many are compared at a time.
SKETCH, STEP = 512, 128
_SEED = np.random.default_rng(1966)
_XOR = _SEED.integers(0, 2**63, HASHES, dtype=np.uint64)
_TIMES = _SEED.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_SKETCH_XOR = _SEED.integers(0, 2**63, SKETCH, dtype=np.uint64)
_SKETCH_TIMES = _SEED.integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes = words.digests()
    runs = run_hashes(hashes, k) if len(hashes) else hashes
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            whole = (hashes[a:b] * PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a)
            out.append(mix(whole))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], xor: np.ndarray = _XOR, times: np.ndarray = _TIMES) -> np.ndarray:
    """The minima of each set under each hash; no set may be empty."""
    out = np.empty((len(sets), len(xor)), np.uint32)
    at, block = 0, 65_536
    sizes = np.cumsum([len(s) for s in sets])
    while at < len(sets):
        until = min(max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + block)), at + 1), len(sets))
        values = np.concatenate(sets[at:until])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : until - 1]])]).astype(np.int64)
        for j in range(len(xor)):
            out[at:until, j] = np.minimum.reduceat((values ^ xor[j]) * times[j], starts) >> np.uint64(32)
        at = until
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH further minima of each set, a byte each."""
    return (signatures(sets, _SKETCH_XOR, _SKETCH_TIMES) & np.uint32(255)).astype(np.uint8)


def _sign(base: DataFrame) -> DataFrame:
    """(id, text_key, size, digest, signature, bands) of each row; the last three are null for an empty set."""
    schema = pa.schema([("size", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column("text"))
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = [{"size": 0, "digest": None, "signature": None, "bands": None} for _ in sets]
                if full:
                    minima = signatures([sets[i] for i in full])
                    grouped = minima.reshape(len(full), -1, BAND_ROWS).astype(np.uint64)
                    keys = mix((grouped * PLACE[:BAND_ROWS]).sum(axis=2) + np.arange(grouped.shape[1], dtype=np.uint64) * PLACE[9]).astype(np.int64)
                    for row, i in enumerate(full):
                        rows[i] = {"size": len(sets[i]), "digest": hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), "signature": minima[row].tobytes(), "bands": keys[row]}
                made = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
                yield pa.record_batch([piece.column("id"), piece.column("text_key"), *made], ["id", "text_key", *schema.names])

    return base.mapInArrow(sign, f"id {base.schema['id'].dataType.simpleString()}, text_key bigint, size bigint, digest binary, signature binary, bands array<bigint>")


def least_equal(n: int, threshold: float, miss: float) -> int:
    """The fewest equal hashes of n with which P(similarity >= threshold) isn't below miss: that is P(Binomial(n + 1, threshold) <= m)."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _needed(hashes: int, step: int, chance: float) -> dict[int, int]:
    """After so many hashes, the fewest equal ones that keep a pair. chance: that of unlike minima to look equal."""
    at_least = PERCENT / 100 * (1 - chance) + chance
    return {n: least_equal(n, at_least, MISS) for n in range(step, hashes + 1, step)}


def _survivors(pairs: DataFrame, classes: DataFrame, kind: type = np.uint32, needed: dict[int, int] | None = None) -> DataFrame:
    """The pairs (a, b) that sequential verification doesn't prune. classes: (digest, signature, size)."""
    needed = needed or _needed(HASHES, BATCH, 0.0)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive, equal, before = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int32), 0
            for n, least in needed.items():
                equal += np.count_nonzero(left[alive, before:n] == right[alive, before:n], axis=1)
                some, before = equal >= least, n
                alive, equal = alive[some], equal[some]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    own = classes.select(F.col("digest").alias("da"), F.col("signature").alias("sa"), F.col("size").alias("na"))
    other = classes.select(F.col("digest").alias("db"), F.col("signature").alias("sb"), F.col("size").alias("nb"))
    met = pairs.join(own, F.col("a") == F.col("da")).join(other, F.col("b") == F.col("db"))
    met = met.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))  # the union is no smaller than the larger set
    return met.select("a", "b", "sa", "sb").mapInArrow(verify, "a binary, b binary")


def _sketched(nodes: DataFrame, texts: DataFrame, met: DataFrame) -> DataFrame:
    """(digest, signature, size, bands) of some nodes, the signature being their sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                made = sketches(shingle_sets(piece.column("text")))
                yield pa.record_batch([piece.column("digest"), pa.array([m.tobytes() for m in made], pa.binary())], ["sd", "signature"])

    open_texts = texts.join(nodes, F.col("digest") == F.col("node"), "left_semi")
    made = open_texts.mapInArrow(run, "sd binary, signature binary")
    return made.join(met.select("digest", "size", "bands"), F.col("sd") == F.col("digest")).select("digest", "signature", "size", "bands")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = shingle_sets(part.column("ta")), shingle_sets(part.column("tb"))
                linked = []
                for x, y in zip(left, right, strict=True):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(linked))

    met = pairs.join(texts.select(F.col("digest").alias("da"), F.col("text").alias("ta")), F.col("a") == F.col("da"))
    met = met.join(texts.select(F.col("digest").alias("db"), F.col("text").alias("tb")), F.col("b") == F.col("db"))
    return met.select("a", "b", "ta", "tb").mapInArrow(confirm, "a binary, b binary")


def _open_members(members: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(key, node, component, members) of the buckets whose members are in different components."""
    lab = labels.select(F.col("node").alias("n"), "component")
    known = members.join(lab, F.col("node") == F.col("n")).select("key", "node", "component")
    stats = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    return joined_by_key(known, stats.filter("lo != hi").select(F.col("key").alias("k"), "members"), "key", "k", "members", total).drop("k")


def _paired(small: DataFrame) -> DataFrame:
    """The pairs of different components in small buckets."""
    x, y = (small.select(F.col("key").alias(f"k{i}"), F.col("node").alias(i), F.col("component").alias(f"c{i}")) for i in "ab")
    return x.join(y, (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()


def spanning_links(x: list[np.ndarray], y: list[np.ndarray], same: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of x and sets of y, as few as join what all of them join. same: pairs that need none."""
    common = np.zeros((len(x), len(y)), np.float32)
    shared = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)))
    for at in range(0, len(shared), 8192):
        some = shared[at : at + 8192]
        marks = []
        for sets in (x, y):
            mark = np.zeros((len(sets), len(some)), np.float32)
            for i, s in enumerate(sets):
                mark[i, np.searchsorted(some, s[np.isin(s, some)])] = 1
            marks.append(mark)
        common += marks[0] @ marks[1].T
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
    group = list(range(len(x) + len(y)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    out = []
    for i, j in np.argwhere((100 * common >= PERCENT * union) & ~same).tolist():
        p, q = root(i), root(len(x) + j)
        if p != q:
            group[p] = q
            out.append((i, j))
    return out


def block_survivors(sides: tuple[pd.DataFrame, pd.DataFrame], key: int, needed: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sides (node, component, main, size, signature, bands) that sequential verification leaves, of those in different
    components which share no band before `key`; a pair of two left members counts once."""
    left, right = sides
    x, y = (np.frombuffer(b"".join(side["signature"]), np.uint8).reshape(len(side), -1) for side in sides)
    bx, by = (np.stack(side["bands"].tolist()) for side in sides)
    sizes, nodes, parts = ([side[c].to_numpy() for side in sides] for c in ("size", "node", "component"))
    place = int(np.flatnonzero(by[0] == key)[0])
    later = right["main"].to_numpy()
    out = []
    for i in range(len(left)):
        fit = (100 * np.minimum(sizes[0][i], sizes[1]) >= PERCENT * np.maximum(sizes[0][i], sizes[1])) & (parts[1] != parts[0][i])
        alive = np.flatnonzero(fit & (later | (nodes[1] > nodes[0][i])))
        equal, before = np.zeros(len(alive), np.int32), 0
        for n, least in needed.items():
            equal += np.count_nonzero(y[alive, before:n] == x[i, before:n], axis=1)
            some, before = equal >= least, n
            alive, equal = alive[some], equal[some]
        kept = alive[~(by[alive, :place] == bx[i, :place]).any(axis=1)]
        out.append(np.stack([np.full(len(kept), i), kept]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.empty(0, int), np.empty(0, int))


def _block_links(large: DataFrame, sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within large buckets (key, node, component), found block by block."""
    parts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("size", "component"))["component"].alias("most"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("minor"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    placed = large.join(main, F.col("key") == F.col("k")).select("key", "node", "component", (F.col("component") == F.col("most")).alias("main"), blocks("all").alias("nb"), blocks("minor").alias("na"))
    placed = placed.withColumn("draw", F.xxhash64("node", "key"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "node", "component", "main"]
    left = placed.filter("NOT main").select(*kept, F.lit(True).alias("minor"), F.pmod(F.col("draw"), F.col("na")).alias("a"), every("nb").alias("b"))
    right = placed.select(*kept, F.lit(False).alias("minor"), every("na").alias("a"), F.pmod(F.col("draw"), F.col("nb")).alias("b"))
    units = left.unionByName(right).join(sketched, F.col("node") == F.col("digest")).drop("digest")
    needed = _needed(SKETCH, STEP, 1 / 256)

    def compare(unit):
        key, a, b = (unit[c].iloc[0] for c in ("key", "a", "b"))
        minor = unit["minor"].to_numpy()
        sides = unit[minor], unit[~minor]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame(columns=["unit", "a", "b", "i", "j"], dtype=object)
        i, j = block_survivors(sides, key, needed)
        if not len(i):
            return pd.DataFrame(columns=["unit", "a", "b", "i", "j"], dtype=object)
        (own, i), (other, j) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        names = [side["node"].iloc[rows].tolist() for side, rows in zip(sides, (own, other), strict=True)]
        return pd.DataFrame({"unit": [f"{key},{a},{b}"], "a": [names[0]], "b": [names[1]], "i": [i.astype(np.int32).tobytes()], "j": [j.astype(np.int32).tobytes()]})

    found = written(units.groupBy("key", "a", "b").applyInPandas(compare, "unit string, a array<binary>, b array<binary>, i binary, j binary"), "near-blocks")
    sides = [found.select("unit", F.lit(name == "a").alias("first"), F.posexplode(name).alias("place", "node")) for name in "ab"]
    filled = sides[0].unionByName(sides[1]).join(texts, F.col("node") == F.col("digest")).select("unit", "first", "place", "text")

    def confirm(about, side_texts):
        if not len(about):
            return pd.DataFrame(columns=["a", "b"], dtype=object)
        unit = about.iloc[0]
        sides = [side_texts[side_texts["first"] == first].sort_values("place") for first in (True, False)]
        sets = [shingle_sets(pa.array(side["text"], pa.large_string())) for side in sides]
        left_out = np.ones((len(unit["a"]), len(unit["b"])), bool)
        left_out[np.frombuffer(unit["i"], np.int32), np.frombuffer(unit["j"], np.int32)] = False
        links = spanning_links(*sets, left_out)
        return pd.DataFrame({"a": [unit["a"][i] for i, _ in links], "b": [unit["b"][j] for _, j in links]})

    return found.groupBy("unit").cogroup(filled.withColumnRenamed("unit", "u").groupBy("u")).applyInPandas(confirm, "a binary, b binary")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links (a, b)."""
    own, other = (labels.select(F.col("node").alias(f"n{i}"), F.col("component").alias(f"c{i}")) for i in "ab")
    joined = links.join(own, F.col("a") == F.col("na")).join(other, F.col("b") == F.col("nb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(joined).select(F.col("node").alias("was"), F.col("component").alias("now"))
    return labels.join(merged, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chosen: str | None = None) -> DataFrame:
    """df with n_shingles, component_id (the smallest id that links reach) and kept (id = component_id).

    chosen: a further column's name, true for rows with the least id (null last) and of these the least text hash of their
    component; those are copies of one text with one id. Each row with an empty set is a component."""
    base = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    signed = written(_sign(base), "near-signed")
    full = signed.filter("size > 0")
    pick = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key"))
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"), pick.alias("pick"), F.first("signature").alias("signature"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes, "near-classes")

    banded = classes.select(F.explode("bands").alias("key"), F.col("digest").alias("node"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1").select(F.col("key").alias("k"), "centre", "members")
    total = classes.count() * (HASHES // BAND_ROWS)
    starred = joined_by_key(banded, written(buckets, "near-keys"), "key", "k", "members", total).select("key", "node", "centre")
    starred = written(starred, "near-buckets")
    members, stars = starred.select("key", "node"), starred.filter("node != centre")
    nodes = written(starred.select("node").distinct(), "near-nodes")
    met = written(classes.join(nodes, F.col("digest") == F.col("node"), "left_semi").select("digest", "pick", "signature", "size", "bands"), "near-met")
    sought = met.select("digest", F.col("pick.id").alias("i"), F.col("pick.text_key").alias("t"))
    texts = base.join(sought, (F.col("text_key") == F.col("t")) & F.col("id").eqNullSafe(F.col("i"))).select("digest", "text").dropDuplicates(["digest"])
    texts = written(texts, "near-texts")

    pairs = written(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "near-stars")
    labels = nodes.select("node", F.col("node").alias("component"))
    links = written(_confirmed(_survivors(pairs, met), texts), "near-links")
    if not links.isEmpty():
        labels = written(_merged(labels, links), "near-labels")

    left = written(_open_members(members, labels, total), "near-open")
    sketched = written(_sketched(left.select("node").distinct(), texts, met), "near-sketched")
    fresh_pairs = _paired(left.filter(F.col("members") <= PAIRED)).join(pairs, ["a", "b"], "left_anti")
    links = _confirmed(_survivors(fresh_pairs, sketched, np.uint8, _needed(SKETCH, STEP, 1 / 256)), texts)
    large = left.filter(F.col("members") > PAIRED)
    if not large.isEmpty():
        links = links.unionByName(_block_links(large, sketched, texts))
    links = written(links, "near-links")
    if not links.isEmpty():
        labels = written(_merged(labels, links), "near-labels")

    of_class = classes.select("digest", "rep", "pick").join(labels, F.col("digest") == F.col("node"), "left").select("digest", "rep", "pick", F.coalesce("component", "digest").alias("component"))
    smallest = of_class.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("pick").alias("least")).withColumnRenamed("component", "c")
    ids = of_class.join(smallest, F.col("component") == F.col("c")).select(F.col("digest").alias("d"), "component_id", "least")
    found = signed.join(ids, F.col("digest") == F.col("d"), "left").select("id", "text_key", F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), (F.col("d").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_key") == F.col("least.text_key")))).alias("chosen"))
    added = ["n_shingles", "component_id", "kept", *[chosen] * bool(chosen)]
    if set(df.columns) <= {id_col, text_col} and not chosen:
        return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    passed = [c for c in df.columns if c not in added]
    key, there = fresh(passed, "text_key"), fresh(passed, "found")
    found = found.distinct().select(F.struct("id", "text_key", "n_shingles", "component_id", "chosen").alias(there))
    keyed = df.select(*passed, F.xxhash64(text_col).alias(key))
    joined = keyed.join(found, (F.col(key) == F.col(f"{there}.text_key")) & keyed[id_col].eqNullSafe(F.col(f"{there}.id")))
    kept = F.col(f"{there}.id").eqNullSafe(F.col(f"{there}.component_id")).alias("kept")
    return joined.select(*passed, *(F.col(f"{there}.{n}").alias(n) for n in ("n_shingles", "component_id")), kept, *([F.col(f"{there}.chosen").alias(chosen)] if chosen else []))


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
