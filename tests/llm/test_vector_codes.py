import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import vector_codes as V

DATA = "/root/testdata/sf0.01"


def brute(rows):
    """Rows (vec_id, vector, label) by plain integers: (vec_id, code, error, label_error) and the digest of the codebooks."""
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    kept = [(i, [hold(math.floor(min(max(256.0 * x, -1e300), 1e300))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 16)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[(v + [0] * (16 * width - len(v)))[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    books = [[list(x[p]) for x in parts[:64]] for p in range(16)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p, book in enumerate(books):
            members = {}
            for x in parts:
                members.setdefault(nearest(x[p], book)[1], []).append(x[p])
            for k, own in members.items():
                book[k] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], {}
    for (i, _, label), x in zip(kept, parts):
        found = [nearest(x[p], books[p]) for p in range(16)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), hold(sum(d for d, _ in found)), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    return sorted(((i, c, e, hold(sums[label])) for i, c, e, label in out), key=key), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def coded(df):
    made, books = V.encode_vectors(df)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    return sorted((tuple(r) for r in V.label_errors(made).select("vec_id", "code", "error", "label_error").collect()), key=key), books.sha256()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute(rows)
    got = V.op13_vector_codes(spark, DATA).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}


def test_nearest_is_exact_where_float32_is_not():
    dice = np.random.default_rng(4)
    for size, width in ((300, 4), (30_000, 4), (3_000_000, 7), (2**40, 3), (2**62, 2)):
        c = dice.integers(-size, size, (64, width))
        c[10:20] = c[0] + dice.integers(-1, 2, (10, width))  # near ties
        c[30] = c[5]  # ties
        x = np.concatenate([c[dice.integers(0, 64, 300)] + dice.integers(-3, 4, (300, width)), dice.integers(-size, size, (100, width))])
        index, distance, _ = V.nearest(x, c)
        exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)), k) for k, e in enumerate(c)) for row in x]
        assert [(int(d), int(k)) for d, k in zip(distance, index)] == exact
    few = V.nearest(dice.integers(-300, 300, (1000, 4)), dice.integers(-300, 300, (64, 4)))[2]
    assert few < 1100  # of 64,000 distances


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [], None), (3, [None, 1.0], 1), (4, [float("nan")], 1), (5, [1.0, float("-inf")], 2), (None, [0.5] * 20, None), (7, [0.1, -0.2, 0.3], 5), (7, [0.1, -0.2, 0.3], 5), (7, [-9.0, 4.0], None), (8, [1e30, -1e30, 1e300], 6), (9, [3e15] * 33, 6)]
    rows += [(100 + i, [i / 7.0, -i / 3.0, 0.125], i % 3) for i in range(90)]
    df = spark.createDataFrame([(*r, "taken", 0) for r in rows], "vec_id long, embedding array<double>, label int, code string, integers int")
    assert coded(df) == brute(rows)
    assert coded(df.filter("vec_id = 2")) == brute(rows[1:2])
    assert coded(df.limit(0)) == ([], hashlib.sha256().hexdigest())
    made, _ = V.encode_vectors(df)
    assert made.columns == ["vec_id", "embedding", "label", "integers", "code", "error"]


@pytest.mark.parametrize("at_once", [64, 4_000_000])
def test_slices_change_nothing(spark, monkeypatch, at_once):
    monkeypatch.setattr(V, "AT_ONCE", at_once)
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").filter(F.col("vec_id") < 40).repartition(3)
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert coded(df) == brute(rows)
