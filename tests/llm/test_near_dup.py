import random
import re

import pytest

from inkveil.llm import near_dup as N

DATA = "/root/testdata/sf0.001"


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and 100 * common >= 75 * (len(x) + len(sets[j]) - common) and common:
                group[root(i)] = root(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[root(i)] = min(best.get(root(i), k), k)
    return sorted(((k, len(sets[i]), best.get(root(i)), k == best.get(root(i))) for i, (k, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r[0], r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert found(N.near_components(docs)) == brute([tuple(r) for r in docs.collect()])


def noisy(dice, words, n):
    out = list(words)
    for i in dice.sample(range(len(out)), n):
        out[i] = f"z{dice.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("paired, block", [(4, 7)])
def test_groups(spark, monkeypatch, paired, block):
    """Groups around the threshold, chains, exact copies and odd rows; with tiny limits, many blocks."""
    monkeypatch.setattr(N, "PAIRED", paired)
    monkeypatch.setattr(N, "BLOCK", block)
    dice = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Ab c"), (5, "aB c"), (6, "one two three four five"), (None, "One two three four five"), (7, "É x y z w v"), (8, "é x y z w v"), (None, None)]
    rows += [(10 + i, "same text again and again all the way down " * 2) for i in range(20)]
    base = [f"w{dice.randrange(5000)}" for _ in range(120)]
    rows += [(100 + i, noisy(dice, base, dice.randrange(1, 4))) for i in range(40)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(300 + i, " ".join(chain[3 * i : 3 * i + 60])) for i in range(40)]
    rows += [(6, "one two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(N.near_components(df))
    assert [g[:3] for g in got] == [b[:3] for b in brute(rows)]
    clash = df.selectExpr("doc_id", "text", "1 as kept", "2 as text_key", "3 as found", "4 as digest", "5 as id")
    got = N.near_components(clash)
    assert got.columns == ["doc_id", "text", "text_key", "found", "digest", "id", "n_shingles", "component_id", "kept"]
    assert [g[:3] for g in found(got)] == [b[:3] for b in brute(rows)]


def test_empty_table(spark):
    assert N.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_bounds():
    assert N.least_equal(128, 0.75, 1e-6) < 75 < N.least_equal(128, 0.75, 0.5)


def test_words_that_polynomials_confuse(spark):
    """The Thue-Morse word of 2,048 letters and its complement have one polynomial hash modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join(letters[b] for b in bits) for letters in ("ab", "ba")]
    dice = random.Random(1)
    rows = [(1, " ".join(dice.choice(words) for _ in range(14))), (2, " ".join(dice.choice(words) for _ in range(14))), (3, " ".join([words[0]] * 9)), (4, " ".join([words[1]] * 9))]
    assert found(N.near_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_blocks_of_a_template(spark, monkeypatch):
    """A hundred texts of one template, most of them short of the threshold, some beyond it, in buckets that are cut in blocks."""
    monkeypatch.setattr(N, "PAIRED", 3)
    monkeypatch.setattr(N, "BLOCK", 10)
    dice = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(base + [f"w{dice.randrange(10**6)}" for _ in range(dice.choice([10, 20, 25, 30, 60]))])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(N.near_components(df)) == brute(rows)


def test_sketches_prune_what_is_far_and_keep_what_is_near():
    import numpy as np

    dice = np.random.default_rng(2)
    sets = []
    for common in (150, 172, 400):  # of 200: similarity 0.6, 0.75, 1
        x = dice.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [np.unique(x), np.unique(np.r_[x[:common], dice.integers(0, 2**63, max(0, 200 - common), dtype=np.uint64)])]
    made = N.sketches(sets)
    needed = N._needed(N.SKETCH, N.STEP, 1 / 256)
    kept = [all((made[i, :n] == made[i + 1, :n]).sum() >= least for n, least in needed.items()) for i in (0, 2, 4)]
    assert kept == [False, True, True]
