"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so that a record is read by its place alone.  Of records with
equal payloads of some size one is a response and the others are revisits that refer to it.

Index: captures are sorted by their key, the URL with its host reversed, and written in compressed blocks of
lines.  At the end of each index file stands a sparse directory with the first and last key of every block.  A
lookup finds its index file among the files' bounds (one row per task that wrote), its blocks in that
file's directory by binary search, decompresses these blocks only, and reads the records they name by range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import parts_of
from playtrail.llm.files import new_file, open_file
from playtrail.scratch import scratch_path, through_table

LEAST_SHARED = 1000
BLOCK_LINES = 1000
ARCHIVE_BYTES = 1 << 28
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"CAPINDX1"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def capture_key(url: str | None) -> str:
    """Reversed host, port, path and query in one sortable key; empty for null.

    Scheme, user, ``www.`` and fragment do not count; host names are lower-cased.  What is no URL with a host is its own key.
    """
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        host = ""
    if not host:
        return _quoted(url)
    host = host.removeprefix("www.")
    reversed_host = ",".join(reversed(host.split(".")))
    usual = {"http": 80, "https": 443}.get(u.scheme.lower())
    at = f":{port}" if port not in (None, usual) else ""
    return _quoted(f"{reversed_host}{at}){u.path or '/'}{'?' + u.query if u.query else ''}")


def _quoted(s: str) -> str:
    """Without white space and control characters, so that it fits a header or an index line."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", s).encode("utf-8", "replace").decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def parse_record(data: bytes) -> dict:
    """Headers, payload and the values of ``READ`` of an uncompressed record.

    A response's size and digest are those of the payload that is read, and an error if its headers name others.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])

    def page(name: str) -> int | None:
        number = headers.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(number) if number else None

    size, digest = int(fields["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        found = (len(payload), hashlib.sha1(payload).hexdigest())
        if found != (size, digest):
            raise ValueError(f"the payload of {headers['WARC-Record-ID']} is not what its headers say")
        size, digest = found
    return {
        "page_id": page("WARC-Record-ID"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "url": headers.get("WARC-Target-URI"),
        "payload": payload,
    }


CAPTURES = "key string, page_id bigint, archive string, offset bigint, length bigint"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def write_archives(pages: DataFrame, least_shared: int = LEAST_SHARED, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` and return the captures: (key, page_id, archive, offset, length).

    Reads ``page_id``, ``url`` and ``html``; null html is an empty payload, a null URL has the empty key.  Of records with equal
    payloads of at least ``least_shared`` bytes, that with the largest page_id is the response and the others revisit it; rows
    that repeat that id, and rows without any id to refer to, are responses as well.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    light = rows.where(F.length("payload") >= least_shared).select("digest", "page_id")
    # Only payloads that stand more than once are joined back.
    shared = (
        light.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ).select(F.col("digest").alias("shared"), "first")
    marked = rows.join(shared, (F.col("digest") == F.col("shared")) & (F.length("payload") >= least_shared), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = None, None, 0
        try:
            for b in batches:
                found = []
                for page, url, data, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        (name, out), at = new_file(folder, ".warc.gz"), 0
                    member = gzip.compress(record_bytes(page, url, data, digest, refers, refers is not None), 6, mtime=0)
                    out.write(member)
                    found.append((capture_key(url), page, name, at, len(member)))
                    at += len(member)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                yield _batch(found, CAPTURES)
        finally:
            if out is not None:
                out.close()

    return through_table(marked.mapInArrow(write, CAPTURES), "captures")


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array([r[i] for r in rows], _KINDS[t]) for i, (_, t) in enumerate(fields)]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])


BOUNDS = "file string, first string, last string, n_blocks bigint, n_captures bigint"


def write_index(captures: DataFrame, folder: str | None = None, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures into index files; returns one row per file with the bounds of its keys."""
    folder = folder or scratch_path(captures.sparkSession, "capture_index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = out = first = last = None
        held, directory, at, n = [], [], 0, 0

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
            directory.append((held[0][0], held[-1][0], at, len(data)))
            out.write(data)
            at += len(data)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, out = new_file(folder, ".idx")
                    first = row[0]
                held.append(row)
                last, n = row[0], n + 1
                if len(held) >= lines:
                    flush()
        if out is None:
            yield _batch([], BOUNDS)
            return
        if held:
            flush()
        foot = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        out.close()
        yield _batch([(name, first, last, len(directory), n)], BOUNDS)

    by = [F.asc("key"), F.asc_nulls_first("page_id"), F.asc("archive"), F.asc("offset")]
    ordered = captures.select("key", "page_id", "archive", "offset", "length").repartitionByRange(parts_of(captures), *by)
    return through_table(ordered.sortWithinPartitions(*by).mapInArrow(write, BOUNDS), "index_files")


class IndexFile:
    """One index file: its directory is read when it is opened, blocks when they are needed."""

    def __init__(self, name: str):
        self.file = open_file(name)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a whole index file")
        (n,) = struct.unpack("<Q", tail[:8])
        self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - len(MAGIC) - n)))
        self.firsts = [d[0] for d in self.directory]
        self.lasts = [d[1] for d in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def block(self, k: int) -> tuple[list, list[str]]:
        """The captures of a block and their keys."""
        if self.held[0] != k:
            _, _, at, length = self.directory[k]
            lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")]
            self.held = (k, (lines, [x[0] for x in lines]))
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """All captures of the key: binary search in the directory, then in each block."""
        for k in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            lines, keys = self.block(k)
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]


def locate(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """Captures of the distinct ``keys`` (one string column), found through the index."""
    # One row per task that wrote an index file: bounded by the number of partitions.
    files = sorted((r["first"], r["last"], r["file"]) for r in bounds.select("first", "last", "file").collect())
    firsts, lasts, names = ([f[i] for f in files] for i in range(3))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, k)
                for k in b.column(0).to_pylist()
                for i in range(bisect_left(lasts, k), bisect_right(firsts, k))
            ]
            yield _batch(rows, "number bigint, key string")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = None, None
        for b in batches:
            rows: list = []
            for i, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != number:
                    number, index = i, IndexFile(names[i])
                for capture in index.find(key):
                    rows.append(tuple(capture))
                    if len(rows) >= 10_000:
                        yield _batch(rows, CAPTURES)
                        rows = []
            yield _batch(rows, CAPTURES)

    routed = keys.toDF("key").where("key is not null").distinct().mapInArrow(route, "number bigint, key string")
    # Ranges rather than hashes: a file that is asked for often is read by several tasks.
    spread = routed.repartitionByRange(parts_of(keys), "number", "key").sortWithinPartitions("number", "key")
    return spread.mapInArrow(find, CAPTURES)


def fetch(captures: DataFrame, payload: bool = False) -> DataFrame:
    """Read the records at the given places: the columns of ``READ``, with url and payload on request."""
    schema = READ + (", url string, payload binary" if payload else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            for lo in range(0, len(b), 500):
                rows = []
                for archive, offset, length in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns), strict=True):
                    if archive != name:
                        name, file = archive, open_file(archive)
                    record = parse_record(gzip.GzipFile(fileobj=io.BytesIO(file.read_at(length, offset))).read())
                    rows.append(tuple(record[c] for c in names))
                yield _batch(rows, schema)

    by = ["archive", "offset"]
    places = captures.select("archive", "offset", "length").repartitionByRange(parts_of(captures), *by)
    return places.sortWithinPartitions(*by).mapInArrow(read, schema)


def keys_of(urls: DataFrame) -> DataFrame:
    """The keys of a table whose one column holds URLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(capture_key(u),) for u in b.column(0).to_pylist()], "key string")

    return urls.select(F.col(urls.columns[0]).cast("string")).mapInArrow(run, "key string")


def archive_and_read_back(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Archive and index all pages, then look every URL up in the index and read the records it names."""
    bounds = write_index(write_archives(pages, least_shared))
    return fetch(through_table(locate(keys_of(pages.select("url")), bounds), "found"))
