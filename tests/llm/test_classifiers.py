import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import quality as Q
from inkveil.llm import toxicity as X

DATA = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (None, "some text"), (3, "x" * 40_000), (3, "x" * 40_000), (4, "é " * 300)]


def auc(y, s):
    r = np.argsort(np.argsort(s))
    n = y.sum()
    return (r[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def labelled(spark, column):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    return docs, labels, truth, held


def test_quality_on_held_out_rows(spark):
    docs, labels, truth, held = labelled(spark, "quality")
    model = Q.train(docs, labels)
    rows = Q.score_quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).select("doc_id", "score").collect()
    rows = [r for r in rows if r.doc_id in held]
    assert auc(np.array([truth[r.doc_id] for r in rows]), np.array([r.score for r in rows])) > 0.97


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth, held = labelled(spark, "toxic")
    model = X.train(docs, labels)
    assert (np.diff(model["thresholds"]) >= 0).all()
    rows = X.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).collect()
    rows = [r for r in rows if r.doc_id in held]
    y, s = np.array([truth[r.doc_id] for r in rows]), np.array([r.severity for r in rows])
    flagged = np.array([r.toxic for r in rows])
    assert auc(y, s) > 0.97 and flagged[y == 0].mean() < 0.01 and flagged[y == 1].mean() > 0.85
    assert ((s >= 0) & (s <= X.GRADES)).all()


@pytest.mark.parametrize("labels", [[], [(9, 1, 0)], [(i, i % 2, i % 2) for i in range(40)]])
def test_odd_rows(spark, labels):
    docs = spark.createDataFrame(ODD + [(i, "bad idiot text" if i % 2 else "a fine day") for i in range(10, 40)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wide = docs.selectExpr("*", "1 as score", "2 as severity", "3 as whole_text", "4 as id")
    got = Q.score_quality(wide, Q.train(docs, marks))
    assert got.columns == ["doc_id", "text", "severity", "whole_text", "id", "score"]
    assert got.count() == 36 and all(0 <= r.score <= 1 for r in got.collect())
    got = X.score_toxicity(wide, X.train(docs, marks))
    assert got.columns == ["doc_id", "text", "score", "whole_text", "id", "severity", "grade", "toxic"]
    assert got.count() == 36 and all(0 <= r.severity <= X.GRADES for r in got.collect())
    assert Q.score_quality(docs.limit(0), {"constant": np.array(0.5)}).collect() == [] == X.score_toxicity(docs.limit(0), None).collect()


def test_chunks_cover_the_whole_text():
    text = bytes(range(1, 256)) * 9
    parts = Q.chunks(text)
    step = Q.CHUNK - Q.OVERLAP
    assert b"".join(p[:step].tobytes() for p in parts[:-1]) + parts[-1].tobytes().rstrip(b"\0") == text
    assert len(Q.chunks(b"")) == 1


def test_gradients():
    dice = np.random.default_rng(1)
    bags = [dice.integers(0, 256, (n, Q.CHUNK), dtype=np.uint8) for n in (1, 3)]
    model = {k: v.astype(np.float64) for k, v in Q.initial().items()}
    y = np.array([0.0, 1.0])

    def loss(m):
        s = np.concatenate([Q._probability(m, Q._combined(np.maximum((Q._columns(m, b) @ m["filter"]).reshape(len(b), Q._PLACES, -1).max(axis=1) + m["bias"], 0), np.array([0]), np.array([len(b)]))) for b in bags])
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    grads = Q._gradients(model, bags, y)
    for name in model:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        up, down = ({k: v.copy() for k, v in model.items()} for _ in "12")
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=0.02, abs=1e-7)


def test_features():
    text, place, value = X.features(pa.array(["Bad, bad! day", None, "", "bad"]))
    assert set(text) == {0, 3} and np.isclose(value.max(), np.log(3)) and place[text == 3][0] in place[text == 0]


def test_ordinal_gradients():
    dice = np.random.default_rng(3)
    n, features = 30, 12
    text, place = np.repeat(np.arange(n), 4), dice.integers(0, features, 4 * n)
    value, grade = dice.random(4 * n), dice.integers(0, X.GRADES + 1, n)
    weights, thresholds = dice.standard_normal(features), np.array([-1.0, 0.1, 0.7, 1.5])
    _, by_weight, by_threshold = X.loss(weights, thresholds, text, place, value, grade)
    for x, slope in ((weights, by_weight), (thresholds, by_threshold)):
        for i in range(len(x)):
            both = []
            for by in (1e-6, -1e-6):
                x[i] += by
                both.append(X.loss(weights, thresholds, text, place, value, grade)[0])
                x[i] -= by
            assert slope[i] == pytest.approx((both[0] - both[1]) / 2e-6, rel=1e-3, abs=1e-6)


def test_a_repeated_id_teaches_once(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (None, "d")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    from inkveil.llm.labelled import learning_rows

    held = {k for k in (1, 2) if zlib.crc32(str(k).encode()) % 4 == 2}
    got = sorted(map(tuple, learning_rows(docs, marks, "toxic", 10).collect()))
    assert got == [r for r in [(1, 1, ""), (2, 0, "c")] if r[0] not in held]


def test_very_long_texts_go_through_in_slices(monkeypatch):
    dice = np.random.default_rng(5)
    bags = [dice.integers(0, 256, (n, Q.CHUNK), dtype=np.uint8) for n in (1, 9)]
    y = np.array([0.0, 1.0])
    model = {k: v.astype(np.float64) for k, v in Q.initial().items()}
    whole = Q._gradients(model, bags, y)
    monkeypatch.setattr(Q, "SLICE", 2)
    monkeypatch.setattr(Q, "HELD", 4)
    for name, g in Q._gradients(model, bags, y).items():
        assert np.allclose(g, whole[name])


def test_learners_are_averaged_by_rows():
    one, two = Q.Descent(Q.initial(1)), Q.Descent(Q.initial(2))
    one.steps, two.steps = 4, 3
    made = Q.averaged([(1, one), (3, two)])
    assert made.steps == 4
    for k, v in made.model.items():
        assert np.allclose(v, 0.25 * one.model[k] + 0.75 * two.model[k], atol=1e-6)


@pytest.mark.parametrize("n", [5, 300])
def test_learning_twice_gives_one_network(spark, n):
    docs = spark.createDataFrame([(i, ("noise zz qq " if i % 2 else "a calm and clear line ") * (1 + i % 7)) for i in range(n)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id long, quality int")
    first, second = Q.train(docs, marks), Q.train(docs.repartition(7), marks.repartition(3))
    assert all(np.array_equal(first[k], second[k]) for k in first)
    scores = Q.score(first, [b"noise zz qq noise zz qq", b"a calm and clear line"])
    assert scores[0] < 0.5 < scores[1]
