import gzip
import hashlib

import pytest

from inkveil.llm import warc as A

DATA = "/root/testdata/sf0.001"


def brute(rows):
    out, seen = [], {}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for page, _, html in sorted(rows, key=key):
        b = (html or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and d in seen
        out.append((page, len(b), d, "revisit" if again else "response", seen[d] if again else None))
        seen.setdefault(d, page)
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ODD = [(5, "http://a.example.com/x", "h" * 200), (3, "https://www.a.example.com:443/x", "h" * 200), (4, None, "h" * 200), (9, "http://b.org", None), (8, "http://b.org/", ""), (7, "http://b.org/q?z=1", "h" * 99), (6, "http://b.org/q?z=1", "h" * 99), (None, "http://é.net/a b\r\nc", "n" * 150), (None, "ftp://[bad", "n" * 150), (2, "http://c.io:8080/é", "ü" * 60), (1, "http://c.io/", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (5, "http://a.example.com/x", "h" * 200), (10, "http://d.io/", "long " * 40000)]


@pytest.mark.parametrize("lines", [A.BLOCK_LINES, 3])
def test_round_trip(spark, monkeypatch, lines):
    monkeypatch.setattr(A, "BLOCK_LINES", lines)
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()] + ODD[:4] + ODD[4:]
    df = spark.createDataFrame(rows, pages.schema).repartition(3).selectExpr("*", "1 as payload", "2 as digest", "3 as nth")
    archive = A.write_archives(df)
    everything = A.read_all(archive)
    assert found(everything) == brute(rows)
    assert all(r.whole for r in everything.collect())
    payload = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in rows}
    assert all(r.payload == payload[r.payload_digest] for r in everything.collect() if r.record_type == "response")
    for limit in (A.DIRECTORY_ROWS, 0):
        monkeypatch.setattr(A, "DIRECTORY_ROWS", limit)
        asked = [r[1] for r in rows[::3]] + ["http://nowhere.example/"]
        keys = {A.url_key(u) for u in asked}
        hits = A.lookup(archive, spark.createDataFrame([(u,) for u in asked], "url string"))
        assert sorted(r.page_id or -1 for r in hits.collect()) == sorted(p or -1 for p, u, _ in rows if A.url_key(u) in keys)


def test_empty_table(spark):
    archive = A.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert A.read_all(archive).collect() == []
    assert A.lookup(archive, spark.createDataFrame([("http://a/",)], "url string")).collect() == []


def test_record_is_plain_warc():
    raw = gzip.decompress(A._record(1, "http://a/b", b"abc", "d", 1, False, None))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nabc\r\n\r\n")
    assert A.url_key("HTTP://www.Blog.Example.com:80/a?b") == "com,example,blog)/a?b"
