import duckdb

from inkveil.llm import chat_format as C

DATA = "/root/testdata/sf0.001"


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(t is None, t or 0, (r or "unknown").replace("<|", "< |"), (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv]
        turns.sort()
        for speaker in {t[2] for t in turns} - {"system"}:
            text, mask = "", []
            for _, _, role, body in turns:
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
                start = len(text)
                text += body + "<|end|>\n"
                if role == speaker:
                    mask.append((start, len(text)))
            out.append((conv, speaker, len(turns), len(mask), text, mask))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.speaker, r.n_turns, r.n_targets, r.rendered, [tuple(m) for m in r.mask]) for r in df.collect()), key=str)


def test_documents(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert found(C.rotate_perspectives(turns)) == brute([tuple(r) for r in turns.collect()])


def test_sql(spark):
    got = sorted(map(tuple, C.op3_chat_format(spark, DATA).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS FROM '{DATA}/conversations.parquet'")
        assert got == sorted(db.sql(C.OP3_SQL).fetchall())


def test_odd_rows(spark):
    rows = [(1, 0, "ann", "hi <|end|> é😀"), (1, 1, "bob", None), (1, None, "eve", "late"), (1, 1, "ann", ""), (None, 0, "x", "n"), (None, 1, None, "m"), (2, 0, "system", "only"), (3, 0, "<|z|>", "q " * 3000), (1, 0, "ann", "hi <|end|> é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as speaker", "3 as turns")
    assert found(C.rotate_perspectives(df)) == brute(rows)
    assert C.rotate_perspectives(df.limit(0)).collect() == []
