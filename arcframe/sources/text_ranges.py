"""Text files in ranges of bytes: a data source whose lines keep their file and place.

    register(spark)
    spark.read.format("text_ranges").option("splitBytes", 64 << 20).load("/data/*.txt")

Rows: file, offset, within, line, range. Ranges are numbered over all files in the order of
their names, and a task reads its ranges in order: one, or with option tasks (load sets it)
neighbours of TASK_BYTES at most together, of which a file's are read in one go. A line belongs
to the range in which it begins; one that begins where a range ends belongs to the range that
ends there, so a range behind the first passes over what stands before its first line feed, and
each line occurs once.

In gzip files a range holds the members that begin in it: offset is the place of the member
in which a line begins and within its place in the member's content (0 in plain files). A
file of one member is one range's work; its unpacked size is estimated from a prefix, so that
ranges of gzip files hold about splitBytes of text.

With option plan (a folder written by budgets.write_plan) ranges are those of the plan.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from arcframe.sources.ranges import Ranged, list_files, open_system

SCHEMA = "file string, offset long, within long, line string, range long"
SPLIT_BYTES, SAMPLE_BYTES, TASK_BYTES, PIECE = 64 << 20, 1 << 20, 16 << 20, 1 << 20
#: Rows of a batch, and bytes behind a range that are looked at for its last line's end at once.
BATCH_ROWS, BEHIND = 1 << 16, 4 << 10
GZIP = b"\x1f\x8b\x08"


def gzip_factor(path: str, sample: int = SAMPLE_BYTES) -> float:
    """Unpacked bytes per packed byte, from the first `sample` unpacked bytes; 1 for what is no gzip file."""
    f = Ranged(path)
    try:
        made = used = 0
        for piece, place in _member(f, 0):
            made, used = made + len(piece), place
            if made >= sample:
                break
        return made / used if used else 1.0
    except zlib.error:
        return 1.0
    finally:
        f.close()


def _member(f: Ranged, at: int) -> Iterator[tuple[bytes, int]]:
    """(piece of content, place behind the bytes used) of the gzip member at a place, a piece at a time."""
    machine = zlib.decompressobj(31)
    while not machine.eof:
        body = machine.unconsumed_tail or f.some(at)
        if not body:
            raise zlib.error(f"{at}: the member is cut off")
        if not machine.unconsumed_tail:
            at += len(body)
        piece = machine.decompress(body, PIECE)
        place = at - len(machine.unconsumed_tail) - len(machine.unused_data)
        yield piece, place
    yield b"", at - len(machine.unused_data)


def _is_member(f: Ranged, at: int) -> bool:
    """Whether a magic begins a member: its first piece can be unpacked."""
    try:
        next(_member(f, at))
        return True
    except zlib.error:
        return False


def _plain(f: Ranged, at: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    while at < f.size:
        body = f.some(at)[: max(0, end - at) + BEHIND]
        yield at, 0, body
        at += len(body)


def _members(f: Ranged, at: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset of the member, place in it, piece) of all members from a place on."""
    while at < f.size and f.read(at, 3) == GZIP:
        within, place = 0, at
        for piece, place in _member(f, at):
            if piece:
                yield at, within, piece
                within += len(piece)
        at = place


def _first_member(f: Ranged, begin: int, end: int) -> int:
    at = f.find(GZIP, begin, end)
    while at >= 0 and not _is_member(f, at):
        at = f.find(GZIP, at + 1, end)
    return at


class Block(NamedTuple):
    """Whole lines that follow each other: the places where they begin, and their bytes, a line feed behind each.

    owner: the last place before a line that is part of its range: where a line begins with
    a range (or a range's first member), it belongs to the range before.
    """

    offset: np.ndarray
    within: np.ndarray
    owner: np.ndarray
    body: bytes


def blocks(f: Ranged, begin: int, end: int, packed: bool | None = None) -> Iterator[Block]:
    """The lines that belong to [begin, end) of a file; packed: whether it is a gzip file, where that is known."""
    packed = is_packed(f) if packed is None else packed
    if packed:
        begin_at = 0 if begin == 0 else _first_member(f, begin, min(end, f.size))
        pieces = _members(f, begin_at) if begin_at >= 0 else iter(())
    else:
        pieces = _plain(f, begin, end)
    # start: (offset, within, owner) of the line that goes on; late: the first member behind the range.
    skipping, held, start, late, before = begin > 0, [], None, None, begin
    for offset, within, piece in pieces:
        if packed and late is None and offset >= end:
            late = offset
        if skipping and (late is not None if packed else offset >= end):
            return
        if start is None:
            if packed:
                start = (offset, within, offset if within else before)
            else:
                start = (offset, 0, max(0, offset - 1))
            if not skipping and (late is not None and start[:2] != (late, 0) if packed else offset > end):
                return
        before = offset
        stops = np.flatnonzero(np.frombuffer(piece, np.uint8) == 10)[: 1 if late is not None else None]
        if not len(stops):
            if not skipping:
                held.append(piece)
            continue
        begins = stops[:-1] + 1
        if packed:
            places = np.append(start[0], np.full(len(begins), offset)), np.append(start[1], within + begins), np.append(start[2], np.full(len(begins), offset))
            n = len(stops)
        else:
            places = np.append(start[0], offset + begins), np.zeros(len(stops), np.int64), np.append(start[2], offset + begins - 1)
            n = int(np.searchsorted(places[0], end, "right"))
        first = 1 if skipping else 0
        if n > first:
            body = piece[stops[0] + 1 if skipping else 0 : stops[n - 1] + 1]
            yield Block(*(x[first:n] for x in places), b"".join([*held, body]))
        if n < len(stops) or late is not None:
            return
        at = int(stops[-1]) + 1
        skipping, held, start = False, [piece[at:]], None
        if at < len(piece):
            start = (offset, within + at, offset) if packed else (offset + at, 0, offset + at - 1)
            if not packed and start[0] > end:
                return
    if start is not None and not skipping:
        yield Block(*(np.array([x], np.int64) for x in start), b"".join([*held, b"\n"]))


def lines(f: Ranged, begin: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, within, line) of the lines that belong to [begin, end) of a file."""
    for block in blocks(f, begin, end):
        yield from zip(block.offset.tolist(), block.within.tolist(), block.body.split(b"\n"))


def is_packed(f: Ranged) -> bool:
    return f.read(0, 3) == GZIP


def span_blocks(f: Ranged, begin: int, end: int, packed: bool) -> Iterator[Block]:
    """blocks() of a plain file between two places where lines begin; of a gzip file all of it."""
    return blocks(f, 0, f.size, True) if packed else blocks(f, max(0, begin - 1), end - 1, False)


def _strings(body: bytes) -> pa.Array:
    """The lines of a block without a carriage return at their end; bytes that are no UTF-8 are replaced."""
    body = body.replace(b"\r\n", b"\n")
    stops = np.flatnonzero(np.frombuffer(body, np.uint8) == 10)
    ends = np.append(0, stops - np.arange(len(stops))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(stops), pa.py_buffer(ends), pa.py_buffer(body.replace(b"\n", b"")))
    try:
        found.validate(full=True)
        return found
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in body.split(b"\n")[:-1]], pa.string())


class _Range(InputPartition):
    """Spans (file, begin, end, number of the first range, bytes of a range); of a plan's bin all have its number."""

    def __init__(self, spans: list[tuple[str, int, int, int, int]], exact: bool = False):
        self.spans, self.exact = spans, exact


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.plan = options.get("plan")
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options.get("path")]
        self.split = max(1, int(options.get("splitBytes") or options.get("splitbytes") or SPLIT_BYTES))
        self.tasks = int(options.get("tasks") or 0)

    def partitions(self):
        if self.plan:
            bins = [[(*span, number, 0) for span in spans] for number, spans in sorted(read_plan(self.plan).items())]
            return [_Range(x, True) for x in _shared(bins, [sum(end - begin for _, begin, end, *_ in x) for x in bins], self.tasks)] or [_Range([])]
        spans = []
        for path, size in (x for path in self.paths for x in list_files(path)):
            step, factor = self.split, 1.0
            if path.endswith(".gz") and size > step:
                factor = max(1.0, gzip_factor(path))
                step = max(1, int(step / factor))
            spans += [(path, at, at + step, step, (min(size, at + step) - at) * factor) for at in range(0, size, step)]
        found = []
        for task in _shared([[(i, *x)] for i, x in enumerate(spans)], [x[-1] for x in spans], self.tasks):
            own = []
            for number, path, begin, end, step, _ in task:
                if own and own[-1][0] == path:
                    own[-1] = (path, own[-1][1], end, *own[-1][3:])
                else:
                    own.append((path, begin, end, number, step))
            found.append(_Range(own))
        return found or [_Range([])]

    def read(self, partition):
        f = at = None
        try:
            for path, begin, end, number, step in partition.spans:
                if path != at:
                    if f is not None:
                        f.close()
                    f, at = Ranged(path), path
                    packed = is_packed(f)
                for block in (span_blocks if partition.exact else blocks)(f, begin, end, packed):
                    n = len(block.offset)
                    ranges = number + (block.owner - begin) // step if step else np.full(n, number)
                    columns = [pa.repeat(path, n), pa.array(block.offset), pa.array(block.within), _strings(block.body), pa.array(ranges)]
                    batch = pa.RecordBatch.from_arrays(columns, names=["file", "offset", "within", "line", "range"])
                    for row in range(0, n, BATCH_ROWS):
                        yield batch.slice(row, BATCH_ROWS)
        finally:
            if f is not None:
                f.close()


def _shared(units: list[list], costs: list[float], tasks: int) -> list[list]:
    """Neighbouring units as one, of TASK_BYTES and of a share of all costs in `tasks` at most; with no tasks each by itself."""
    most = min(TASK_BYTES, sum(costs) / tasks) if tasks else 0
    out, filled = [], 0
    for unit, cost in zip(units, costs):
        if not out or filled + cost > most:
            out.append([])
            filled = 0
        out[-1].extend(unit)
        filled += cost
    return out


def read_plan(folder: str) -> dict[int, list[tuple[str, int, int]]]:
    """bin -> its (file, begin, end), in order, of a plan's Parquet folder."""
    from pyarrow import dataset

    system, path = open_system(folder)
    table = dataset.dataset(path, filesystem=system, format="parquet").to_table()
    out: dict[int, list] = {}
    for number, _, *span in sorted(zip(*(table.column(c).to_pylist() for c in ("bin", "part", "file", "begin", "end")))):
        out.setdefault(number, []).append(tuple(span))
    return out


class TextRanges(DataSource):
    @classmethod
    def name(cls):
        return "text_ranges"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextRanges)


def load(spark: SparkSession, path: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, offset, within, line, range) of the lines of text files; small neighbouring ranges share a task, while every core has four."""
    register(spark)
    reader = spark.read.format("text_ranges").option("splitBytes", str(split_bytes)).option("tasks", str(4 * spark.sparkContext.defaultParallelism))
    return reader.load(path) if isinstance(path, str) else reader.option("paths", json.dumps(path)).load()
