import re
from collections import Counter

import pytest

from inkveil.llm import substring_dedup as S

DATA = "/root/testdata/sf0.001"


def brute(rows, window):
    """rows: (id, text) -> sorted (id, n_words, n_removed, kept)."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r.n_words, r.n_removed, r.kept_text) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    assert found(S.dedup_substrings(docs)) == brute([tuple(r) for r in docs.collect()], 35)


@pytest.mark.parametrize("share", [S.HOT_SHARE, 1e-9])
def test_odd_rows(spark, monkeypatch, share):
    monkeypatch.setattr(S, "HOT_SHARE", share)
    words = "the quick brown fox\tjumps\nover the lazy dog and runs far away".split(" ")
    line = " ".join(words)
    rows = [(1, line), (2, "x y " + line + " z"), (3, None), (4, ""), (5, " \n "), (None, "a b c d e f g h"), (6, "q " * 30), (7, line), (7, line), (8, "é   ü " * 9), (9, "solo"), (10, "pre " + line[:30] + " post"), (None, None)]
    rows += [(100 + i, f"n{i} common line of words here m{i} k{i} j{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(S.dedup_substrings(df, window=6, mer=3)) == brute(rows, 6)
    clash = df.selectExpr("doc_id", "'x' as kept_text", "text", "1 as lo", "2 as id", "3 as _key")
    got = S.dedup_substrings(clash, window=6, mer=3)
    assert got.columns == ["doc_id", "text", "lo", "id", "_key", "n_words", "n_removed", "kept_text"]
    assert found(got) == brute(rows, 6)


def test_empty_table(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
