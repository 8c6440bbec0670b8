"""WARC archives with a two-level capture index.

Writing: each task writes its pages as gzip members, one a record, to archives of its own.  Payloads of at least
``REVISIT_BYTES`` that occur again are stored once, under the largest page_id; the others become revisit records.

Index: capture lines, sorted by reversed-host URL key and page_id, in gzip blocks; each index file ends with a sparse
directory of its blocks' first keys.  A look-up finds the file by its first key (one entry a file), the block by binary
search in the directory, and reads just that block and then just the record's bytes.

Null html is an empty payload.  A null url is indexed as ``urn:page:<page_id>``.  A null page_id never wins a group.
Repeated page_ids give a record each and are all found.  An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import WholeFile, fresh, open_file, written
from ._text import chunks

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 300
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, page_id long, archive string, at long, size long"


def url_key(url: Column) -> Column:
    """``https://Blog.example.com:80/a?b#c`` becomes ``com,example,blog:80)/a?b``: captures of a domain sort together."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^([^/?]*)", 1), "^.*@", ""))
    names, port = F.regexp_replace(host, ":[0-9]*$", ""), F.regexp_extract(host, "(:[0-9]*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(names, "\\.")), ","), port, F.lit(")"), F.regexp_replace(rest, "^[^/?]*", ""))


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member; with ``refers_to`` a revisit, which keeps the HTTP headers and drops the body."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return _gzip("\r\n".join(head).encode() + block + b"\r\n\r\n")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(member: bytes) -> dict:
    """The headers and payload of one record; a response's digest is checked against its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    number = lambda k: int(headers[k]) if headers.get(k, "").strip() else None
    return {"page_id": number("Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": number("Refers-To-Page-ID"), "payload": payload}


# ---------------------------------------------------------------- writing


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path = None, ""
        for batch in batches:
            for part in chunks(batch, "html"):
                rows = []
                for key, page_id, url, html, refers in zip(*(part.column(c).to_pylist() for c in ("url_key", "page_id", "url", "html", "refers_to"))):
                    if out is None or out.size >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        # a name for each attempt: the manifest holds only what the attempt that counted has written
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = WholeFile(path)
                    member = record(page_id, url, html.encode(), refers)
                    rows.append((key, page_id, path, out.write(member), len(member)))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["url_key", "page_id", "archive", "at", "size"])
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages under ``folder``; returns their captures (url_key, page_id, archive, at, size)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("url_key", url_key(F.col("url"))).withColumn("content", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha2("html", 256)))
    # partial counts shrink a hot payload before the shuffle; few payloads are left, and Spark splits a skewed join
    again = rows.filter("content is not null").groupBy("content").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = written(again, "payloads")
    # short payloads have no group: a key of their own deals them out, where nulls would all meet in one task
    rows = rows.withColumn("content", F.coalesce("content", F.concat(F.lit("short "), F.xxhash64("page_id", "url_key", "html").cast("string"))))
    rows = rows.join(again, "content", "left").withColumn("refers_to", F.when(F.coalesce(F.col("page_id"), F.lit(-(2**63))) != F.col("first"), F.col("first")))
    return written(rows.select("url_key", "page_id", "url", "html", "refers_to").mapInArrow(_archived(folder), CAPTURE), "captures")


# ---------------------------------------------------------------- the index


def _indexed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, block, directory, first, total = f"{folder}/{uuid.uuid4().hex}.cdx", None, [], [], None, 0

        def flush() -> None:
            data = _gzip("\n".join(block).encode())
            directory.append([*json.loads(block[0])[:2], out.write(data), len(data)])
            block.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "archive", "at", "size"))):
                if out is None:
                    out, first = WholeFile(path), row[:2]
                block.append(json.dumps(row))
                total += 1
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            footer = _gzip(json.dumps(directory).encode())
            out.write(footer + len(footer).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_pydict({"first_key": [first[0]], "first_page": pa.array([first[1]], pa.int64()), "path": [path], "lines": pa.array([total], pa.int64())})

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Range-sorted index files; returns their manifest (first_key, first_page, path, lines), a row a file."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return written(ranged.mapInArrow(_indexed(folder), "first_key string, first_page long, path string, lines long"), "capture-index")


def _place(key: str, page_id: int | None) -> tuple[str, float]:
    """Order of captures: nulls first, as Spark sorts them."""
    return key, float("-inf") if page_id is None else page_id


class IndexFile:
    """A block directory in memory, and the last block that was read."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.blocks = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - length), 31))
        self.firsts = [_place(*b[:2]) for b in self.blocks]
        self.have: tuple[int, list] = (-1, [])

    def block(self, i: int) -> list:
        if self.have[0] != i:
            _, _, at, size = self.blocks[i]
            self.have = i, [json.loads(x) for x in zlib.decompress(self.file.read_at(size, at), 31).decode().split("\n")]
        return self.have[1]

    def find(self, key: str, page_id: int | None) -> list[list]:
        """All captures of a key and page.  Equal ones may begin at the end of the block before."""
        place, found = _place(key, page_id), []
        i = bisect_right(self.firsts, place) - 1
        while i >= 0:
            found += [x for x in self.block(i) if x[0] == key and x[1] == page_id]
            if self.firsts[i] < place:
                break
            i -= 1
        return found


@lru_cache(8)
def _index_file(path: str) -> IndexFile:
    return IndexFile(path)


@lru_cache(64)
def _archive(path: str):
    return open_file(path)


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def _looked_up(files: list[tuple[str, int | None, str]], bodies: bool):
    firsts = [_place(k, p) for k, p, _ in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, size = [], None, 0
            for key, page_id in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist()):
                if (key, page_id) == last:
                    continue  # asked for again: all its captures have been given
                last = key, page_id
                i = bisect_right(firsts, _place(key, page_id)) - 1
                captures = []
                while i >= 0:
                    captures += _index_file(files[i][2]).find(key, page_id)
                    if firsts[i] < _place(key, page_id):
                        break
                    i -= 1
                for _, _, archive, at, length in captures:
                    r = parse(_archive(archive).read_at(length, at))
                    rows.append([r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"].decode() if bodies and r["record_type"] == "response" else None])
                    size += len(r["payload"])
                if len(rows) >= 1000 or bodies and size >= 4 << 20:
                    yield _found(rows)
                    rows, size = [], 0
            if rows:
                yield _found(rows)

    return run


def _found(rows: list) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "html": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds.values())], list(kinds))


def look_up(index: DataFrame, wanted: DataFrame, bodies: bool = False) -> DataFrame:
    """The records of each (url, page_id) in ``wanted``, by way of the index; with ``bodies`` also responses' html.

    Requests are range-sorted like the index, so a task's look-ups touch neighbouring blocks.  Each distinct request is
    answered once, with all its captures.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = sorted(((r.first_key, r.first_page, r.path) for r in index.collect()), key=lambda x: _place(*x[:2]))  # a row a file
    url = F.coalesce(F.col("url").cast("string"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    asked = wanted.select(url_key(url).alias("url_key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    asked = asked.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return asked.mapInArrow(_looked_up(files, bodies), FOUND)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages, folder = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), fresh(spark, "warc")
    index = write_index(write_archives(pages, folder), folder)
    return look_up(index, pages).drop("html")
