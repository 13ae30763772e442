import random
import re

import pytest

from inkveil.llm import mixing as M

DATA = "/root/testdata/sf0.001"


def wanted(sizes):
    """Targets by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= full
    return out


def check(rows, got, slack):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + n(t)
    target = wanted(sizes)
    assert sorted(((r.id, r["size"]) for r in got), key=str) == sorted(((k, n(t)) for k, t, _ in rows), key=str)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    for s in sizes:
        own = [r for r in got if r.source == s]
        largest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= slack * largest + 1e-6


@pytest.mark.parametrize("block", [M.BLOCK_UNITS, 7])
def test_documents(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_UNITS", block)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    first = sorted(M.mix_sources(docs).collect(), key=str)
    check([tuple(r) for r in docs.collect()], first, 1)
    assert sorted(M.mix_sources(docs.repartition(5)).collect(), key=str) == first


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (None, "q r", None), (5, "w " * 500, "x"), (6, "one two", "z")] + [(7, "same words here", "x")] * 50 + [(i, "t " * (i % 9), "é") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as taken", "2 as size", "3 as order")
    check(rows, M.mix_sources(df).collect(), 1)


def test_empty_tables(spark):
    assert M.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {r.taken for r in M.mix_sources(blank).collect()} == {0}


def test_flight_keeps_totals():
    dice = random.Random(5)
    sizes = [dice.choice((1, 2, 2, 30, 500)) for _ in range(400)]
    chances = [dice.random() for _ in sizes]
    out = M.fly(sizes, chances, dice)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(chances), abs=1e-5)
    assert sum(x * p for x, p in zip(sizes, out)) == pytest.approx(sum(x * p for x, p in zip(sizes, chances)), abs=1e-3)


@pytest.mark.parametrize("n", [1, 4, 700])
def test_targets_of_many_sources(spark, n):
    dice = random.Random(n)
    sizes = {(None if i == 0 else f"s{dice.random()}"): dice.choice((0, 1, 5, 5, 40, 3000)) for i in range(n)}
    got = M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert len(got) == n
    target = wanted(sizes)
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) for r in got)
