"""The opN_ queries themselves, with all columns that they are to return, against brute force on a small folder of tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkveil.llm import mixing, near_dup, quality, substring_dedup, token_counts, toxicity
from inkveil.llm.common import Words

from . import test_mixing, test_near_dup, test_substring_dedup

LINE = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, LINE, "en", "a"), (2, "start " + LINE + " end", "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \n\t", "en", "b"), (6, LINE, "fr", "a"), (None, LINE.upper(), "en", "c"), (8, "one two", "en", "c"),
    (9, "one two", "de", "c"), (10, "long " * 4000, "en", "a"), (11, LINE[:200] + " other words " + LINE[200:], "en", "é"), (12, "é😀 " * 300, "fr", "é"), (13, "the end of <|endoftext|> it " * 90, "en", "b"), (14, LINE, "en", "a"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = DOCS + [(i, f"fine text about thing {i} and more" if i % 2 else f"click here {i} buy now!!! $$$ idiot", "en", "abc"[i % 3]) for i in range(20, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, i % 2, 1 - i % 2) for i in range(20, 80)] + [(1, 1, 0), (1, 0, 0), (999, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_key(rows):
    return sorted(map(tuple, rows), key=str)


def test_op2(spark, folder):
    path, rows = folder
    got = substring_dedup.op2_substring_dedup(spark, path).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(k, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, n, gone, kept in test_substring_dedup.brute([r[:2] for r in rows], 35)]
    assert by_key(got) == by_key(want)


def test_op4(spark, folder):
    path, rows = folder
    got = mixing.op4_source_mixing(spark, path)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = test_mixing.wanted(sizes)
    size_of = sorted((str(k), len(words(t)), sizes[s], round(target[s], 6)) for k, t, _, s in rows)
    found = got.select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6)) for r in found) == size_of and all(0 <= r.taken <= 2 * r["size"] for r in found)


def plain_score(model, text):
    """The network for one text, window by window."""
    if "constant" in model:
        return float(model["constant"])
    pooled = []
    step = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-(len(text) - quality.OVERLAP) // step))
    for c in range(n):
        chunk = text[c * step : c * step + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            x = np.concatenate([model["embed"][b] for b in chunk[at : at + quality.WIDTH]])
            best = np.maximum(best, x @ model["filter"])
        pooled.append(np.maximum(best + model["bias"], 0))
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    hidden = np.tanh(features @ model["hidden"] + model["hidden_bias"])
    return float(1 / (1 + np.exp(-(hidden @ model["out"] + model["out_bias"][0]))))


def test_op5(spark, folder):
    path, rows = folder
    got = quality.op5_quality(spark, path).select("doc_id", "held_out", "score", "predicted").collect()
    model = quality.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2
    want = {k: plain_score(model, (t or "").encode()) for k, t, *_ in rows[:20]}
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.score == pytest.approx(want[r.doc_id], abs=2e-3) for r in got if r.doc_id in want)


def plain_severity(model, text):
    """The sum over grades of the chances that they are passed, for one text, word by word."""
    place = lambda w: int(Words(pa.array([w], pa.binary())).hashes()[0] % np.uint64(toxicity.SPACE))
    times = Counter()
    for word in re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        times[place(word)] += 1
        if len(word) > toxicity.HEAD:
            times[place(word[: toxicity.HEAD]) ^ 1] += 1
    total = sum(model["weights"][p] * np.log1p(n) for p, n in times.items())
    return float(sum(1 / (1 + np.exp(-(total - t))) for t in model["thresholds"]))


def test_op6(spark, folder):
    path, rows = folder
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, path).collect()}
    assert len(got) == len(rows) and model is not None
    for k, t, *_ in rows[:40]:
        assert got[k].severity == pytest.approx(plain_severity(model, t), abs=1e-6), k
        assert 0 <= got[k].grade <= toxicity.GRADES


def test_op8(spark, folder):
    path, rows = folder
    got = near_dup.op8_near_dup(spark, path).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert by_key(got) == by_key(test_near_dup.brute([r[:2] for r in rows]))


def test_op9(spark, folder):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path, rows = folder
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [(k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for k, x, *_ in rows]
    got = token_counts.op9_token_counts(spark, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert by_key(got) == by_key((k, b, n, n > 512) for k, b, n in want) and any(r.over_limit for r in got)


def test_pipeline(spark, folder):
    """With an empty benchmark, copies, ties, nulls and columns of clashing names."""
    pipeline = pytest.importorskip("corpus_pipeline")
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as copy", "2 as text_key", "3 as found", "4 as mixed", "5 as chosen", "6 as kept_text", "7 as score", "8 as id")
    for name, stage in pipeline.STAGES:
        before = docs.count()
        made = stage(spark, docs, path)
        assert made.columns[: len(docs.columns)] == docs.columns and len(set(made.columns)) == len(made.columns), name
        docs = spark.createDataFrame(made.collect(), made.schema)
        if name == "near_dedup":
            keys = {(r.doc_id, r.text) for r in docs.collect()}
            links = test_near_dup.brute([r[:2] for r in rows])
            assert len({k for k, *_ in keys}) == len(keys) and len({c for k, _, c, _ in links if k in {i for i, _ in keys}}) == len(keys)
        elif name == "decontamination":
            assert docs.count() == before
        elif name == "mixing":
            assert docs.groupBy("doc_id", "text").count().filter("count > 2").isEmpty()
    assert pipeline.run(spark, path).count() > 0
