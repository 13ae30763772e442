import random
import re
from collections import Counter

from inkveil.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def shingles(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(rows, items):
    """Every window of every text against every item: (id, item, similarity)."""
    out = set()
    for key, text in rows:
        w = words(text)
        for item, t in items:
            v = words(t)
            k, s, best = min(5, len(v)), shingles(v), 0
            if not v or not any(tuple(w[i : i + k]) in s for i in range(len(w) - k + 1)):
                continue
            for i in range(len(w)):
                x = w[i : i + len(v)]
                x = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
                common = sum((x & s).values())
                if x and 100 * common >= 75 * (sum(x.values()) + sum(s.values()) - common):
                    best = max(best, common / (sum(x.values()) + sum(s.values()) - common))
            if best:
                out.add((key, item, round(best, 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.id, r.item_id, round(r.similarity, 9)) for r in df.collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = found(D.contaminated(docs, bench))
    assert got and got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.collect()])


def test_odd_rows(spark):
    dice = random.Random(8)
    item = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(item)), (2, "short item here"), (3, None), (4, ""), (5, "x " * 30), (6, " ".join(item[:22])), (None, "no id for this item but seven words"), (7, " ".join(item))]
    rows = [(1, None), (2, ""), (None, "lead in " + " ".join(item) + " tail"), (3, "A SHORT item here too"), (4, "x " * 500), (5, " ".join(item[5:])), (6, "no id for this item but seven words and more"), (7, "a b " + " ".join(item[:33])), (7, "a b " + " ".join(item[:33]))]
    for i in range(10, 40):
        w = list(item)
        for j in dice.sample(range(40), dice.randrange(1, 3)):
            w[j] = "changed"
        rows.append((i, "pre " * dice.randrange(9) + " ".join(w) + " post" * dice.randrange(9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as text_key", "3 as words", "4 as id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert found(D.contaminated(docs, bench)) == want
    left = D.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, _ in rows if k not in {w[0] for w in want})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).collect() == []
    assert D.contaminated(docs, bench.union(spark.createDataFrame([(1, "a b c d e f")], bench.schema))).collect() == []
    assert D.contaminated(spark.createDataFrame([(1, "a b")], docs.schema), bench).collect() == []
