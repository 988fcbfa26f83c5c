"""WARC and ARC files as a Spark data source, and record columns.

    register(spark)
    spark.read.format("warc").load("/data/*.warc.gz")

Gzip files are read in ranges of SPLIT_BYTES (option splitBytes), other files whole; members,
frames and records are streamed one by one, so a damaged gzip member costs only itself. Rows:
file, offset, length, version, headers, payload. With option mode=raw rows hold the
undecoded record bytes as payload.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from arcframe.functions import digest, surt
from arcframe.operators import budgets
from arcframe.operators.layout import in_ranges
from arcframe.sources.ranges import CHUNK, Ranged, list_files, open_system

SCHEMA = "file string, offset long, length long, version string, headers array<struct<k:string, v:string>>, payload binary"
ARROW = pa.schema(
    [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("version", pa.string()), ("headers", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), ("payload", pa.binary())]
)
BLANK = re.compile(rb"\r?\n\r?\n")
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Bytes in which a record's header is looked for first.
HEAD_BYTES = 1 << 14
GZIP, ZSTD, SKIPPABLE = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18"


def _inflated(f: Ranged, at: int, machine) -> tuple[int, bytes] | None:
    """(length, content) of what a decompressor reads from at to its end; None where it is cut off."""
    start, parts = at, []
    while not machine.eof:
        body = f.some(at)
        if not body:
            return None
        parts.append(machine.decompress(body))
        at += len(body)
    return at - len(machine.unused_data) - start, b"".join(parts)


def gzip_members(f: Ranged, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each readable member that starts in [begin, end).

    Damage skips to the next magic. The file is read in chunks; one member is held at a time.
    """
    end = f.size if end is None else end
    at = f.find(GZIP, begin, end)
    while at >= 0:
        try:
            found = _inflated(f, at, zlib.decompressobj(31))
            if found is None:
                raise zlib.error("cut off")
            yield at, *found
            at = f.find(GZIP, at + found[0], end)
        except zlib.error:
            at = f.find(GZIP, at + 2, end)


def zstd_start(f: Ranged):
    """(place of the first frame, maker of decompressors): a leading skippable frame holds a dictionary."""
    import zstandard

    if f.read(0, 4) != SKIPPABLE:
        return 0, zstandard.ZstdDecompressor()
    size = int.from_bytes(f.read(4, 4), "little")
    raw = f.read(8, size)
    if raw[:4] == ZSTD:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return 8 + size, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))


def zstd_frames(f: Ranged) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of zstd frames."""
    at, maker = zstd_start(f)
    while f.read(at, 4) == ZSTD:
        found = _inflated(f, at, maker.decompressobj())
        if found is None:
            return
        yield at, *found
        at += found[0]


def header_lines(block: bytes) -> list[tuple[str, str]]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
    return [(k.strip(), v.strip()) for k, _, v in pairs]


def _arc(line: bytes, rest: bytes) -> tuple[str, list[tuple[str, str]], int] | None:
    """Version, WARC-like headers and payload size of an ARC header line (5 or 10 fields)."""
    parts = line.decode("utf-8", "replace").split(" ")
    if len(parts) not in (5, 10) or not parts[-1].isdigit():
        return None
    url, ip, stamp, mime = parts[:4]
    date = re.sub(r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d).*", r"\1-\2-\3T\4:\5:\6Z", stamp)
    headers = [("WARC-Type", "response"), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-IP-Address", ip), ("Content-Type", mime), ("Content-Length", parts[-1])]
    if len(parts) == 10:
        more = zip(("ARC-Result-Code", "WARC-Payload-Digest", "ARC-Location", "ARC-Record-Location", "ARC-Filename"), parts[4:9])
        headers += [(k, v) for k, v in more if v != "-"]
    return "ARC/2" if len(parts) == 10 else "ARC/1", headers, int(parts[-1])


def _head(body: bytes, at: int) -> tuple[str, list[tuple[str, str]], int, int, bool] | None:
    """(version, headers, place of the payload, its size, whether it is a record) of a header at `at`.

    A line that begins no record has size 0 and goes. None: the header is cut off.
    """
    end = body.find(b"\n", at)
    if end < 0:
        return None
    line = body[at:end].rstrip(b"\r")
    if line.startswith(b"WARC/"):
        stop = BLANK.search(body, end - 1)
        if not stop:
            return None
        headers = header_lines(body[end + 1 : stop.start()])
        size = dict((k.lower(), v) for k, v in headers).get("content-length") or "0"
        return line.decode("ascii", "replace"), headers, stop.end(), int(size) if size.isdigit() else 0, True
    arc = _arc(line, body)
    if arc is None:
        return "", [], end + 1, 0, False
    return arc[0], arc[1], end + 1, arc[2], not line.startswith(b"filedesc:")


def records(body: bytes) -> Iterator[tuple[int, int, str, list[tuple[str, str]], bytes]]:
    """(offset, length, version, headers, payload) of the records of one member."""
    at = 0
    while at < len(body):
        while body[at : at + 1] in (b"\r", b"\n"):
            at += 1
        head = _head(body, at)
        if head is None:
            return
        version, headers, start, size, kept = head
        if kept:
            yield at, start + size - at, version, headers, body[start : start + size]
        at = start + size


def plain_records(f: Ranged) -> Iterator[tuple[int, int, str, list[tuple[str, str]], bytes]]:
    """records() of an uncompressed file, one record held at a time."""
    at, wide = 0, HEAD_BYTES
    while at < f.size:
        body = f.read(at, min(wide, f.size - at))
        skip = len(body) - len(body.lstrip(b"\r\n"))
        head = _head(body, skip)
        if head is None:
            if wide >= f.size - at:
                return
            wide *= 2
            continue
        version, headers, start, size, kept = head
        if kept:
            yield at + skip, start - skip + size, version, headers, f.read(at + start, size)
        at, wide = at + start + size, HEAD_BYTES


def read_range(path: str, begin: int, end: int, raw: bool) -> Iterator[tuple]:
    """Rows of the members that start in [begin, end) of a gzip file, or of a whole other file."""
    f = Ranged(path)
    try:
        magic = f.read(0, min(4, f.size))
        if magic[:2] != GZIP and magic not in (ZSTD, SKIPPABLE):
            for offset, length, version, headers, payload in plain_records(f) if begin == 0 else ():
                yield path, offset, length, version, headers, f.read(offset, length) if raw else payload
            return
        packed = gzip_members(f, begin, end) if magic[:2] == GZIP else zstd_frames(f) if begin == 0 else ()
        for offset, length, body in packed:
            for _, _, version, headers, payload in records(body):
                yield path, offset, length, version, headers, f.read(offset, length) if raw else payload
    finally:
        f.close()


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA as Arrow batches of about BATCH_BYTES."""
    names = [x.name for x in ARROW]
    held, size = [], 0
    for path, offset, length, version, headers, payload in rows:
        held.append((path, offset, length, version, [{"k": k, "v": v} for k, v in headers], payload))
        size += len(payload)
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), ARROW)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), ARROW)], names=names)


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.raw, self.path = options.get("mode") == "raw", options["path"]
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self):
        """Ranges of gzip files (a member belongs to the range it starts in), other files whole."""
        out = []
        for path, size in list_files(self.path):
            step = self.split if path.endswith(".gz") else max(1, size)
            out += [_Range(path, at, at + step) for at in range(0, max(1, size), step)]
        return out

    def read(self, partition):
        yield from batches(read_range(partition.path, partition.begin, partition.end, self.raw))


class _Writer(DataSourceWriter):
    """Tasks write to names of one attempt in the target's file system; the driver renames what is committed."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows):
        system, folder = open_system(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/.part-{uuid.uuid4().hex}"
        with system.open_output_stream(name, compression=None) as f:
            for row in rows:
                f.write(zlib_member(record_bytes(row["version"], [(h["k"], h["v"]) for h in row["headers"]], bytes(row["payload"] or b""))))
        return _Done(name)

    def commit(self, messages):
        system, folder = open_system(self.path)
        job = uuid.uuid4().hex[:12]
        for i, m in enumerate(x for x in messages if x):
            system.move(m.name, f"{folder}/part-{i:05d}-{job}.warc.gz")

    def abort(self, messages):
        system, _ = open_system(self.path)
        for m in messages:
            if m:
                system.delete_file(m.name)


class _Done(WriterCommitMessage):
    def __init__(self, name):
        self.name = name


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def zlib_member(body: bytes, level: int = 6) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(body) + press.flush()


def record_bytes(version: str, headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """A WARC record; Content-Length is that of the payload."""
    kept = [(k, v) for k, v in headers if k.lower() != "content-length"] + [("Content-Length", str(len(payload)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in kept)
    return f"{version if version.startswith('WARC/') else 'WARC/1.0'}\r\n{head}\r\n".encode() + payload + b"\r\n\r\n"


def header(name: str) -> Column:
    """The last value of a record header, whatever its case."""
    found = F.filter("headers", lambda h: F.lower(h["k"]) == name.lower())
    return F.when(F.size(found) > 0, F.element_at(found, -1)["v"])


def with_fields(rows: DataFrame) -> DataFrame:
    """Records with url, ts14, type, payload_digest and content_type."""
    return rows.select(
        "*",
        header("WARC-Target-URI").alias("url"),
        F.substring(F.regexp_replace(header("WARC-Date"), r"\D", ""), 1, 14).alias("ts14"),
        F.lower(header("WARC-Type")).alias("type"),
        header("WARC-Payload-Digest").alias("payload_digest"),
        F.trim(F.substring_index(header("Content-Type"), ";", 1)).alias("content_type"),
    )


def to_cdx(rows: DataFrame) -> DataFrame:
    """CDX columns of response and revisit records, with offset and file as extras."""
    from arcframe.sources.http import parsed

    found = with_fields(rows).where(F.col("type").isin("response", "revisit")).withColumn("http", parsed(F.col("payload")))
    own = digest.sha1_base32(F.coalesce("http.body", "payload"))
    revisit = F.col("type") == "revisit"
    return found.select(
        surt.surt(F.col("url")).alias("surt"),
        "ts14",
        "url",
        F.when(revisit, "warc/revisit").otherwise(F.coalesce("http.mime", F.lit("-"))).alias("mime"),
        F.coalesce("http.status", F.lit(-1)).alias("status"),
        F.coalesce(F.regexp_replace("payload_digest", "^[a-z0-9]+:", ""), own).alias("digest"),
        F.coalesce("http.location", F.lit("-")).alias("redirect"),
        F.lit("-").alias("meta"),
        F.col("length").alias("compressed_size"),
        F.array(F.col("offset").cast("string"), F.col("file")).alias("extra"),
    )


def unpacked(f: Ranged, begin: int, size: int, starts: dict) -> bytes:
    """The content of a range: a gzip member, a zstd frame (with its file's dictionary) or plain bytes."""
    body = f.read(begin, size)
    if body[:2] == GZIP:
        return zlib.decompressobj(31).decompress(body)
    if body[:4] == ZSTD:
        if "zstd" not in starts:
            starts["zstd"] = zstd_start(f)[1]
        return starts["zstd"].decompressobj().decompress(body)
    return body


def extract(pointers: DataFrame, file: str = "file", offset: str = "offset", length: str = "length", strict: bool = True) -> DataFrame:
    """Records (SCHEMA) that pointers name: each range is read and parsed, and nothing else.

    Pointers are dealt by file and sorted by offset, about a file's worth of neighbours to a
    task. A pointer whose range holds no record is an error, or without strict gives no row.
    """

    named = pointers.select(F.col(file).alias("file"), F.col(offset).cast("long").alias("offset"), F.col(length).cast("long").alias("length"))
    dealt = named.repartition("file", F.floor(F.col("offset") / SPLIT_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(partial(_extracted, strict=strict), SCHEMA)


def _extracted(parts: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """Records of (file, offset, length); a further column goes along with each of its records."""
    f, at, starts = None, None, {}
    for part in parts:
        rows, taken, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for batch in batches(iter(rows)):  # noqa: B023
                own = [batch.schema.field(i).name for i in range(batch.num_columns)]
                more = part.column(3).take(pa.array(taken[: batch.num_rows], pa.int64())) if part.num_columns > 3 else None  # noqa: B023
                del taken[: batch.num_rows]  # noqa: B023
                yield batch if more is None else pa.RecordBatch.from_arrays([*batch.columns, more], names=[*own, "row"])  # noqa: B023

        for i, (path, begin, length) in enumerate(zip(*(c.to_pylist() for c in part.columns[:3]))):
            if path != at:
                if f is not None:
                    f.close()
                f, at, starts = Ranged(path), path, {}
            found = False
            for _, _, version, headers, payload in records(unpacked(f, begin, length, starts)):
                found = True
                rows.append((path, begin, length, version, headers, payload))
                taken.append(i)
                size += len(payload)
            if strict and not found:
                raise ValueError(f"no record in {path} at {begin}, {length} bytes")
            if size >= BATCH_BYTES:
                yield from flush()
                rows, size = [], 0
        yield from flush()
    if f is not None:
        f.close()


def extract_by_budget(pointers: DataFrame, budget: int, file: str = "file", offset: str = "offset", length: str = "length", strict: bool = True) -> DataFrame:
    """Records (SCHEMA), each with `row`, the row of pointers that named it, and `bin`.

    Pointers in the order of files and places are packed next-fit into bins of at most budget
    bytes (a longer one is alone), and a task reads one bin: the work of running an action
    over records by their CDX rows, at a known price a task.
    """
    named = pointers.select(F.col(file).alias("file"), F.col(offset).cast("long").alias("offset"), F.col(length).cast("long").alias("length"), F.struct(*pointers.columns).alias("row"))
    ranged = in_ranges(named, ["file", "offset", "length"])
    width = int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    bins = budgets.bins_of_ranges(ranged.select(F.lit(0).alias("lane"), F.col("__part").alias("part"), "__pos", F.col("length").alias("cost")), "__pos", budget, width)
    placed = ranged.join(bins.select(F.col("part").alias("__part"), "__pos", F.col("bin").cast("int").alias("bin")), ["__part", "__pos"])
    n = (bins.agg(F.max("bin")).first()[0] or 0) + 1
    dealt = placed.repartitionById(n, "bin").sortWithinPartitions("file", "offset").select("file", "offset", "length", F.struct("row", "bin").alias("row"))
    kind = dealt.schema["row"].dataType.simpleString()
    return dealt.mapInArrow(partial(_extracted, strict=strict), f"{SCHEMA}, row {kind}").select("*", F.col("row.bin").alias("bin")).withColumn("row", F.col("row.row"))
