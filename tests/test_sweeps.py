"""Resolution, blocking and lines on long inputs, against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from inkveil.operators.candidates import outside
from inkveil.operators.render import segment_rows
from inkveil.operators.scan import resolve

KIND = "array<struct<rule:int,priority:int,confidence:int,start:int,end:int>>"


def greedy(found, tidy=(), shield=False):
    rows = list(enumerate(found))
    inside = lambda j, b, i, a: b[0] == a[0] and b[3] <= a[3] and b[4] >= a[4] and (b[3:] != a[3:] or j < i)
    rows = [(i, a) for i, a in rows if a[0] not in tidy or not any(inside(j, b, i, a) for j, b in rows)]
    held = [a for _, a in rows if shield and a[0] < 0]
    shields = len(held)
    for _, a in sorted((r for r in rows if not (shield and r[1][0] < 0)), key=lambda r: (-r[1][1], -r[1][2], r[1][3] - r[1][4], r[1][3], r[0])):
        if all(a[3] >= k[4] or k[3] >= a[4] for k in held):
            held.append(a)
    return sorted(held[shields:], key=lambda a: a[3])


def test_resolution_of_clusters_of_any_size(spark):
    dice, rows = random.Random(4), []
    for n in [0, 1, 5, 49, 60, 400] * 4:
        spread, made = dice.choice([1, 3]), []
        for _ in range(n):
            rule, start = dice.choice([-1, *range(6), *range(6), *range(6)]), dice.randrange(max(1, n * spread))
            made.append((rule, 1000 if rule < 0 else dice.choice([1, 5, 9]), dice.choice([1, 2, 3]), start, start + dice.choice([1, 2, 5, 9, 40, n + 1])))
        rows.append((made,))
    df = spark.createDataFrame(rows, f"found {KIND}")
    full = resolve(F.col("found"), lambda c: c["rule"].isin(2, 3), lambda c: c["rule"] < 0)
    for r in df.select("found", resolve(F.col("found")).alias("plain"), full.alias("full")).collect():
        found = [tuple(x) for x in r.found]
        assert [tuple(x) for x in r.plain] == greedy(found)
        assert [tuple(x) for x in r.full] == greedy(found, (2, 3), True)


def test_long_chains_take_no_square_of_time(spark):
    def seconds(n):
        df = spark.createDataFrame([([(0, i % 97, 3, 4 * i, 4 * i + 10) for i in range(n)],)], f"found {KIND}")
        start = time.time()
        kept = df.select(F.size(resolve(F.col("found"))).alias("n")).first().n
        assert n / 4 < kept < n / 2
        return time.time() - start

    seconds(500)
    assert seconds(20_000) < 10 * max(1.0, seconds(5_000))


@pytest.mark.parametrize("size", [0, 3, 40, 700])
def test_blocking(spark, size):
    dice = random.Random(size)
    spans = lambda n: [(s, s + dice.choice([1, 2, 7, 30])) for s in (dice.randrange(3 * size + 1) for _ in range(n))]
    for found, taken in ((spans(size), spans(size // 2)), (spans(size), []), ([], spans(size))):
        df = spark.createDataFrame([(found, taken)], "found array<struct<start:int,end:int>>, taken array<struct<start:int,end:int>>")
        got = [tuple(x) for x in df.select(outside(F.col("found"), F.col("taken")).alias("x")).first().x]
        assert got == sorted(f for f in found if not any(f[0] < t[1] and t[0] < f[1] for t in taken))


def test_lines_of_segments_with_repeated_ids(spark):
    kind = "array<struct<text:string,kind:string,category:string,enabled:boolean>>"
    docs = [(1, "a"), (1, "d \nx"), (None, "\n\nend\n"), (2, ""), (3, "one\ntwo\nthree " * 300)]
    cut = lambda t: [(t[i : i + 5], "match" if i % 2 else "plain", None, None) for i in range(0, len(t), 5)]
    df = spark.createDataFrame([(i, cut(t)) for i, t in docs] + [(9, None)], f"doc_id long, s {kind}").repartition(3)
    want = []
    for i, t in docs:
        line = 0
        for n, (piece, name, _, _) in enumerate(cut(t)):
            for k, part in enumerate(piece.split("\n")):
                line += k > 0
                want += [(i, line, n, part, name)] * bool(part)
    assert sorted(map(tuple, segment_rows(df, "s").collect()), key=repr) == sorted(want, key=repr)
