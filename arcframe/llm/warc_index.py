"""WARC archives with a two-level capture index.

Archives: one gzip member per record; of equal payloads of LEAST_PAYLOAD bytes or more the
one with the smallest id is written as a response, the others as revisits without payload.

Index, level one: capture lines sorted by reversed-host URL key, dealt by key ranges into
shards, in zlib-compressed blocks of BLOCK_LINES lines. Level two: per shard a sparse
directory with the first key and the byte range of every block.

A lookup routes its key to a shard (one row a shard is broadcast), binary-searches the
shard's directory, inflates one block and gets the record's file, offset and length; the
record itself is a range read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import new_folder, shuffle_width, written
from arcframe.llm.shared_files import Appender, RangeReader

LEAST_PAYLOAD = 100
BLOCK_LINES = 1000
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 200_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

CAPTURES = "key string, file string, at long, length long"
POINTERS = "key string, file string, at long, length long"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"

HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)(.*)$", re.IGNORECASE | re.DOTALL)


def url_key(url: str | None) -> str:
    """The reversed-host form of a URL: labels from the right, ')', then path and query.

    Scheme, user, port, fragment and a leading www are left out; white space is escaped.
    """
    plain = re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), (url or "").strip())
    host, rest = HOST.match(plain).groups()
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d*$", "", host.lower()))
    rest = rest.split("#")[0] or "/"
    return ",".join(reversed(host.split("."))) + ")" + rest


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + (1 << 63), '020d')}"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record, uncompressed."""
    name = lambda i: "<urn:x-page:%s>" % ("" if i is None else i)
    block = HTTP_HEAD % len(html) + (b"" if revisit else html)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\s\x00-\x1f]", lambda m: "%%%02X" % ord(m[0]), url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload (behind the HTTP header) of one record."""
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _archiver(folder: str):
    """(page_id, url, html, digest, refers_to, revisit) -> capture lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Appender(folder, "captures", ".warc.gz")
        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in (*batch.columns[:2], batch.column(2).cast(pa.binary()), *batch.columns[3:])]
            for page_id, url, html, digest, refers_to, revisit in zip(*columns):
                press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                body = press.compress(record(page_id, url, html, digest, refers_to, revisit)) + press.flush()
                rows.append((capture_key(url, page_id), out.name, out.append(body), len(body)))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "file", "at", "length"])
        out.close()

    return run


def _indexer(folder: str):
    """Sorted capture lines of one shard -> its block file, its directory and one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, directory = Appender(folder, "index", ".blocks"), Appender(folder, "index", ".directory")
        lines, first, total = [], None, 0

        def close() -> None:
            body = zlib.compress("\n".join(lines).encode(), LEVEL)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{blocks.append(body)}\t{len(body)}\n".encode())

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                first = row[0] if first is None else first
                lines.append("\t".join(map(str, row)))
                if len(lines) == BLOCK_LINES:
                    close()
                    total, lines = total + len(lines), []
        if lines:
            close()
            total += len(lines)
        blocks.close()
        directory.close()
        if total:
            yield pa.RecordBatch.from_pylist([{"name": blocks.name, "directory": directory.name, "first_key": first, "lines": total, "bytes": directory.size}])

    return run


class ShardReader:
    """Lookups in one shard: binary search in the directory, then one inflated block."""

    def __init__(self, reader: RangeReader, name: str, directory: str, size: int):
        rows = [line.split("\t") for line in reader.read(directory, 0, size).decode().splitlines()]
        self.first = [r[0] for r in rows]
        self.ranges = [(int(r[1]), int(r[2])) for r in rows]
        self.reader, self.name, self.held = reader, name, (-1, [], [])

    def _block(self, i: int) -> tuple[list[str], list[list[str]]]:
        if self.held[0] != i:
            at, length = self.ranges[i]
            rows = [line.split("\t") for line in zlib.decompress(self.reader.read(self.name, at, length)).decode().split("\n")]
            self.held = (i, [r[0] for r in rows], rows)
        return self.held[1:]

    def find(self, key: str) -> Iterator[list[str]]:
        """All lines with that key; equal keys may run over several blocks."""
        i = max(0, bisect_right(self.first, key) - 1)
        while i > 0 and self.first[i] == key:
            i -= 1
        while i < len(self.first) and self.first[i] <= key:
            keys, rows = self._block(i)
            at = bisect_right(keys, key)
            begin = at
            while begin > 0 and keys[begin - 1] == key:
                begin -= 1
            yield from rows[begin:at]
            if at < len(keys):
                return
            i += 1


def _finder(folder: str, shards: list[tuple[str, str, int]]):
    """(shard, key) in order -> pointers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shard, at = RangeReader(folder), None, None
        for batch in batches:
            rows = []
            for number, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != at:
                    shard, at = ShardReader(reader, *shards[number]), number
                rows += [(r[0], r[1], int(r[2]), int(r[3])) for r in shard.find(key)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["key", "file", "at", "length"])
        reader.close()

    return run


def _fetcher(folder: str):
    """Pointers -> record facts; the payload's length and digest are computed from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            rows = []
            for name, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "length"))):
                headers, payload = parse_record(zlib.decompress(reader.read(name, at, length), 31))
                told = headers["warc-payload-digest"].removeprefix("sha256:")
                revisit = headers["warc-type"] == "revisit"
                own = told if revisit else hashlib.sha256(payload).hexdigest()
                if own != told:
                    raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
                rows.append((_page(headers["warc-record-id"]), headers["warc-type"], _page(headers.get("warc-refers-to")), None if revisit else len(payload), own))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        reader.close()

    return run


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes WARC files for (page_id, url, html) below folder; capture lines (CAPTURES)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha2("html", 256))
    facts = rows.select("page_id", "digest").where(F.octet_length("html") >= LEAST_PAYLOAD)
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select(F.col("digest"), "first"), "repeated-payloads")
    side = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    marked = rows.join(side, "digest", "left")
    revisit = (F.octet_length("html") >= LEAST_PAYLOAD) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    lines = marked.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return written(lines.mapInArrow(_archiver(folder), CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, str, int]]:
    """Sorts the lines into shards with block files and directories: a row for each shard.

    Returned to the driver: (first key, block file, directory, directory bytes) of each
    shard, as many as shuffle partitions.
    """
    width = shuffle_width(captures.sparkSession)
    lines = captures.repartitionByRange(width, "key").sortWithinPartitions("key", "file", "at")
    shards = written(lines.mapInArrow(_indexer(folder), "name string, directory string, first_key string, lines long, bytes long"), "shards")
    return sorted((r["first_key"], r["name"], r["directory"], r["bytes"]) for r in shards.collect())


def lookup(keys: DataFrame, shards: list[tuple[str, str, str, int]], folder: str) -> DataFrame:
    """Pointers (POINTERS) of all captures of the distinct keys (key string)."""
    firsts = [s[0] for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            found = [max(0, bisect_right(firsts, k) - 1) for k in keys.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.int32)), keys], names=["shard", "key"])

    if not shards:
        return keys.sparkSession.createDataFrame([], POINTERS)
    width = shuffle_width(keys.sparkSession)
    routed = keys.distinct().mapInArrow(route, "shard int, key string")
    return routed.repartitionByRange(width, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(_finder(folder, [s[1:] for s in shards]), POINTERS)


def fetch(pointers: DataFrame, folder: str) -> DataFrame:
    """Record facts (RECORDS) by range reads in the order of file and offset."""
    width = shuffle_width(pointers.sparkSession)
    near = pointers.repartitionByRange(width, "file", "at").sortWithinPartitions("file", "at")
    return near.select("file", "at", "length").mapInArrow(_fetcher(folder), RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive and its index, looks every page up and reads its record.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is
    an empty payload, a null url an empty one. Rows that repeat page_id and payload are all
    responses; a null page_id refers to the smallest id of its payload where there is one.
    An empty table gives an empty result.
    """
    folder = new_folder(pages.sparkSession, "warc")
    captures = write_archive(pages, folder)
    shards = write_index(captures, folder)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [capture_key(u, p) for u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["key"])

    keys = pages.select("url", F.col("page_id").cast("long")).mapInArrow(keyed, "key string")
    records = written(fetch(lookup(keys, shards, folder), folder), "records")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    revisits = records.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    full = F.coalesce("full", F.raise_error(F.lit("a revisit refers to no response")))
    return responses.select(*names).unionByName(revisits.withColumn("payload_bytes", full.cast("long")).select(*names))
