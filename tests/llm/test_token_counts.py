import pytest
from tokenizers import Tokenizer

from inkveil.llm import token_counts as T

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"


def expected(rows):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return sorted(((k, len(t.encode(x or "", add_special_tokens=False))) for k, x in rows), key=str)


def found(df):
    return sorted(((r[0], r.n_tokens) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk, overlap", [(T.CHUNK_CHARS, T.OVERLAP), (500, 90)])
def test_documents(spark, chunk, overlap):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = T.count_tokens(docs, P.path("byte_bpe_50k.json"), chunk_chars=chunk, overlap=overlap)
    assert found(got) == expected([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 3000), (4, " " * 700 + "x"), (5, "ab <|endoftext|> cd<|endoftext|>" * 40), (6, "it's 1234\n\n  x!? é😀 " * 60), (None, "word " * 300), (8, "dup text " * 50), (8, "dup text " * 50), (9, "b" * 200 + " c d e f g h " * 30 + "!" * 150 + "\n" * 99 + "z" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as key", "3 as whole_text", "4 as big_key")
    got = T.count_tokens(df, P.path("byte_bpe_50k.json"), chunk_chars=200, overlap=40)
    assert got.columns == ["doc_id", "text", "key", "whole_text", "big_key", "n_tokens"]
    assert found(got) == expected(rows)


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect() == []
