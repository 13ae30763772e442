"""WARC archives of pages with a two-level capture index.

Writing. Every page is one record, compressed on its own so that it can be read alone. Of equal payloads of at least
REVISIT_BYTES, the one with the smallest id is a response and the others are revisits of it. Tasks write archive files to a
folder that all executors share, under names of their own: a repeated attempt writes another file, and only the rows of the
attempt that Spark commits tell where records are.

Index. Rows (reversed-host key, file, offset, length, page id) are sorted by range and written as compressed blocks of
BLOCK_LINES lines; a sparse directory has each block's first key and place.

Reading. `lookup` finds URLs: binary search of the directory for the blocks that may hold a key; these pairs are dealt by block, so
that a block is read and unpacked once, whatever keys ask for it, and a key with very many captures is spread over its blocks;
binary search of the block's lines; range reads of the records, neighbours of a file in one. A directory of more than
DIRECTORY_ROWS rows isn't broadcast; the index lines are joined by key instead. `read_all` goes through all index blocks.

Payloads are shuffled at most once: which records repeat an earlier payload is found on rows of ids and digests, and of these
digests with more than HOT rows, of which there can be no more than rows / HOT, are joined by broadcast.

Defined cases: a null payload is empty; a null URL has an empty key and no target header; characters that would break a header
are percent-encoded; a null id is larger than all others; of rows with one id and payload the one of the least URL (null last) is the
first, and equal rows are records of their own, of which one is the first; very long payloads are one record; other columns are
left out, whatever their names; an empty table gives an archive of no record.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import work_path, written

REVISIT_BYTES = 100
BLOCK_LINES = 3000
FILE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
DIRECTORY_ROWS = 200_000
HOT = 50_000
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ENTRY = "url_key string, page_id bigint, file string, offset bigint, length bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, whole boolean"


@dataclass
class Archive:
    root: str
    #: (first_key, file, offset, length, lines) of each index block.
    directory: DataFrame


def url_key(url: str | None) -> str:
    """http://www.Blog.example.com:80/a?b becomes com,example,blog)/a?b."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return _header(url)
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return _header(f"{where}){tail}")


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def _record_id(page_id: int | None, digest: str, url: str | None, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest} {nth} {url}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, nth: int, revisit: bool, refers_to: int | None, refers_url: str | None = None) -> bytes:
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()]
    body = head[0] if revisit else head[0] + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, url, nth)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest, refers_url, 1)}"]
        lines += [f"X-Refers-To-Page: {refers_to}"] * (refers_to is not None)
    lines += [f"X-Page-Id: {page_id}"] * (page_id is not None)
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n", 6, mtime=0)


def _parse(data: bytes) -> dict:
    """The row of one compressed record; `whole` says that the payload agrees with its digest."""
    raw = zlib.decompress(data, 31)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    own = None if revisit else hashlib.sha256(payload).hexdigest()
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
        "payload": None if revisit else payload, "payload_bytes": number("X-Payload-Length") if revisit else len(payload),
        "payload_digest": digest if revisit else own, "whole": revisit or own == digest,
    }


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def _typed(rows: list[dict], ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_schema(ddl))


def _plan(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, payload, digest, nth, revisit, refers_to, refers_url) for every page."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # One text for id, payload and URL, so that the join and the numbering of equal rows share one shuffle.
    of_null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("row", F.concat_ws(" ", "digest", of_null("page_id"), of_null("url")))
    slim = base.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("row", "digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    groups = slim.groupBy(F.col("digest").alias("d")).agg(F.min(order).alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    hot = F.broadcast(groups.filter(F.col("rows") > HOT))
    known = F.col("digest") == F.col("d")
    shared = slim.join(hot, known).unionByName(slim.join(hot, known, "left_anti").join(groups.filter(F.col("rows") <= HOT), known))
    own = F.col("page_id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    shared = shared.select(F.col("row").alias("r"), own.alias("own"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    joined = base.join(shared, F.col("row") == F.col("r"), "left")
    nth = F.row_number().over(W.partitionBy("row").orderBy("page_id"))
    revisit = F.col("r").isNotNull() & ~(F.col("own") & (F.col("nth") == 1))
    said = [F.when(revisit, F.col(c)).alias(n) for c, n in (("first_id", "refers_to"), ("first_url", "refers_url"))]
    return joined.withColumn("nth", nth).select("page_id", "url", "payload", "digest", "nth", revisit.alias("revisit"), *said)


def write_archives(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Writes the pages' records and their index under root, or in a new folder of the shared one."""
    spark = pages.sparkSession
    root = root or work_path(spark, "warc")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = _record(row["page_id"], row["url"], row["payload"], row["digest"], row["nth"], row["revisit"], row["refers_to"], row["refers_url"])
                out.write(data)
                rows.append({"url_key": url_key(row["url"]), "page_id": row["page_id"], "file": name, "offset": at, "length": len(data)})
                at += len(data)
            yield _typed(rows, ENTRY)
        if out:
            out.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        fs.create_dir(path, recursive=True)
        out, name, at, lines, keys = None, f"{uuid.uuid4().hex}.idx.gz", 0, [], []
        places = []

        def block() -> None:
            nonlocal out, at
            out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(data)
            places.append({"first_key": keys[0], "last_key": keys[-1], "file": name, "offset": at, "length": len(data), "lines": len(lines)})
            at += len(data)
            lines.clear()
            keys.clear()

        for batch in batches:
            for row in batch.to_pylist():
                keys.append(row["url_key"])
                lines.append(f"{row['url_key']} {'' if row['page_id'] is None else row['page_id']} {row['file']} {row['offset']} {row['length']}")
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out:
            out.close()
        yield _typed(places, "first_key string, last_key string, file string, offset bigint, length bigint, lines bigint")

    entries = written(_plan(pages, id_col, url_col, payload_col).mapInArrow(store, ENTRY), "warc-entries")
    ordered = entries.repartitionByRange(F.col("url_key"), F.col("page_id"), F.col("file"), F.col("offset")).sortWithinPartitions("url_key", "page_id", "file", "offset")
    directory = written(ordered.mapInArrow(index, "first_key string, last_key string, file string, offset bigint, length bigint, lines bigint"), "warc-directory")
    return Archive(root, directory)


def _lines(handle, offset: int, length: int) -> list[str]:
    handle.seek(offset)
    return zlib.decompress(handle.read(length), 31).decode().split("\n")


def _entry(line: str) -> dict:
    key, page, file, offset, length = line.split(" ")
    return {"url_key": key, "page_id": int(page) if page else None, "file": file, "offset": int(offset), "length": int(length)}


def index_entries(archive: Archive) -> DataFrame:
    """All index lines, from their blocks."""
    root = archive.root

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for place in batch.to_pylist():
                with fs.open_input_file(f"{path}/{place['file']}") as handle:
                    yield _typed([_entry(x) for x in _lines(handle, place["offset"], place["length"])], ENTRY)

    return archive.directory.select("file", "offset", "length").mapInArrow(read, ENTRY)


def _fetched(root: str, ddl: str = RECORD):
    """Reads the records of entries that come in order of file and offset, neighbours in one range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        name, handle = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            i = 0
            while i < len(files):
                j = i + 1
                while j < len(files) and files[j] == files[i] and offsets[j] == offsets[j - 1] + lengths[j - 1] and offsets[j] - offsets[i] < RANGE_BYTES:
                    j += 1
                if files[i] != name:
                    if handle:
                        handle.close()
                    name, handle = files[i], fs.open_input_file(f"{path}/{files[i]}")
                handle.seek(offsets[i])
                data = handle.read(offsets[j - 1] + lengths[j - 1] - offsets[i])
                yield _typed([_parse(data[o - offsets[i] : o - offsets[i] + n]) for o, n in zip(offsets[i:j], lengths[i:j], strict=True)], ddl)
                i = j
        if handle:
            handle.close()

    return read


def read_all(archive: Archive) -> DataFrame:
    """Every record, through the index."""
    return _dealt(index_entries(archive)).mapInArrow(_fetched(archive.root), RECORD)


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries by ranges of files, in order."""
    return entries.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / (16 * RANGE_BYTES))).sortWithinPartitions("file", "offset")


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The records of each distinct URL key of urls."""
    root = archive.root
    key = F.pandas_udf(lambda s: s.map(url_key), "string")
    wanted = urls.select(F.col(url_col).alias("url")).distinct().select(key("url").alias("url_key")).distinct()
    if archive.directory.count() > DIRECTORY_ROWS:
        return _dealt(index_entries(archive).join(wanted, "url_key", "left_semi")).mapInArrow(_fetched(root), RECORD)
    rows = archive.directory.sort("first_key", "last_key", "file", "offset").collect()
    sparse = urls.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [r[0] for r in sparse.value]
        for batch in batches:
            at, keys = [], []
            for wanted_key in batch.column("url_key").to_pylist():
                i = bisect.bisect_right(firsts, wanted_key) - 1
                while i >= 0 and sparse.value[i][1] >= wanted_key:  # equal keys may fill several blocks
                    at.append(i)
                    keys.append(wanted_key)
                    i -= 1
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(keys, pa.string())], ["block", "url_key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(root)
        known, lines = None, []
        for batch in batches:
            hits = []
            for block, wanted_key in zip(batch.column("block").to_pylist(), batch.column("url_key").to_pylist(), strict=True):
                if block != known:
                    _, _, file, offset, length, _ = sparse.value[block]
                    with fs.open_input_file(f"{path}/{file}") as handle:
                        known, lines = block, _lines(handle, offset, length)
                first = bisect.bisect_left(lines, wanted_key, key=lambda x: x.split(" ", 1)[0])
                while first < len(lines) and lines[first].split(" ", 1)[0] == wanted_key:
                    hits.append(_entry(lines[first]))
                    first += 1
                if len(hits) >= BLOCK_LINES:
                    yield _typed(hits, ENTRY)
                    hits = []
            yield _typed(hits, ENTRY)

    asked = wanted.mapInArrow(blocks, "block bigint, url_key string").repartition("block").sortWithinPartitions("block", "url_key")
    return _dealt(asked.mapInArrow(search, ENTRY)).mapInArrow(_fetched(root), RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return lookup(write_archives(pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST) AS nth FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND nth > 1 THEN first END AS refers_to
FROM f
"""
