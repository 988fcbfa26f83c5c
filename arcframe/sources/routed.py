"""Savers that decide which file a row goes to: parts that resume, named files, splits by size.

Every file is streamed by one task in the order of its rows and appears under its name once it
is whole, so a lost executor leaves no half file, and a repeated task writes the same one.
A folder is complete when it holds COMPLETE. Large files are cut by next-fit budgets over
ranges (layout.budget_bins), so no task sees more rows than one file or one range has.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcframe.operators import layout
from arcframe.session import stored
from arcframe.sources.ranges import open_system

COMPLETE = "_complete"
WRITTEN = "file string, rows long, bytes long"


class WholeFile:
    """An output that appears under its name when it is closed; until then its name begins with _."""

    def __init__(self, path: str, packed: bool):
        if ".." in path.split("/"):
            raise ValueError(f"{path}: a file's name must not leave its folder")
        self.system, self.path = open_system(path)
        folder, _, name = self.path.rpartition("/")
        self.held = f"{folder}/_{uuid.uuid4().hex}-{name}"
        self.system.create_dir(folder, recursive=True)
        self.out = self.system.open_output_stream(self.held, compression=None)
        self.machine = zlib.compressobj(6, zlib.DEFLATED, 31) if packed else None
        self.rows = self.bytes = 0

    def write(self, data: bytes) -> None:
        self.rows, self.bytes = self.rows + 1, self.bytes + len(data)
        self.out.write(self.machine.compress(data) if self.machine else data)

    def close(self) -> None:
        if self.machine:
            self.out.write(self.machine.flush())
        self.out.close()
        self.system.move(self.held, self.path)


def found(path: str) -> bool:
    from pyarrow import fs

    system, name = open_system(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = ("file", "rows", "bytes"), (pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def _write(df: DataFrame, path: str, name_of: Callable[[str | None], str], packed: bool, keep: bool) -> DataFrame:
    """Streams (file, data) rows, in the order they come, to the files that name_of tells; (file, rows, bytes) of those written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, passing = object(), None, False
        for batch in batches:
            done = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != own:
                    if out is not None:
                        out.close()
                        done.append((own_name, out.rows, out.bytes))
                    own, own_name = file, name_of(file)
                    passing = keep and found(f"{path}/{own_name}")
                    out = None if passing else WholeFile(f"{path}/{own_name}", packed)
                if out is not None:
                    out.write(data or b"")
            if done:
                yield batch_of(done)
        if out is not None:
            out.close()
            yield batch_of([(own_name, out.rows, out.bytes)])

    return stored(df.mapInArrow(run, WRITTEN), "written")


def _finished(path: str, skip_if_exists: bool, keep: bool) -> bool:
    """Whether the folder is complete and may stay; raises where it exists and must not."""
    if skip_if_exists and found(f"{path}/{COMPLETE}"):
        return True
    if found(path) and not (skip_if_exists and keep):
        raise FileExistsError(path)
    return False


def _complete(path: str, written: DataFrame) -> int:
    rows = written.agg(F.sum("rows")).first()[0] or 0
    system, name = open_system(path)
    system.create_dir(name, recursive=True)
    system.open_output_stream(f"{name}/{COMPLETE}", compression=None).close()
    return rows


def save_parts(df: DataFrame, column: str, path: str, packed: bool = False, skip_if_exists: bool = False, per_file: bool = False) -> int:
    """A text file part-NNNNN a partition that has rows; the number of lines written.

    With skip_if_exists a complete folder is left as it is (0); with per_file an incomplete one
    is finished: parts that exist stay, which asks for the same rows in the same partitions.
    A null line is an empty one.
    """
    if _finished(path, skip_if_exists, per_file):
        return 0
    end = ".txt.gz" if packed else ".txt"
    rows = df.select(F.lit("").alias("file"), F.encode(F.concat(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("\n")), "UTF-8").alias("data"))
    return _complete(path, _write(rows, path, lambda _: f"part-{TaskContext.get().partitionId():05d}{end}", packed, skip_if_exists and per_file))


def _data(column: str, df: DataFrame, lines: bool) -> Column:
    value = F.col(column)
    if lines:
        value = F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))
    return (value if df.schema[column].dataType.typeName() == "binary" and not lines else F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")).alias("data")


def _save_bins(df: DataFrame, lane: Column, order: list[str], data: Column, cost: Column, path: str, most: int, name_of: Callable[[str], str], packed: bool, keep: bool) -> DataFrame:
    """Rows cut next-fit within each lane; a file a (lane, bin)."""
    narrow = df.select(lane.alias("lane"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], data)
    placed = layout.dense_ids(narrow, ["lane", *[f"o{i}" for i in range(len(order))], "data"], "id")
    sized = placed.select("id", "lane", "data", cost.cast("long").alias("cost"))
    bins = layout.budget_bins(sized, "id", "cost", most, "lane").select(F.col("ord").alias("id"), "bin")
    rows = sized.join(bins, "id").select(F.concat_ws("\t", "lane", "bin").alias("file"), "id", "data")
    return _write(rows.repartition("file").sortWithinPartitions("file", "id").select("file", "data"), path, name_of, packed, keep)


def save_named_files(df: DataFrame, name: str, data: str, path: str, order: list[str], most_bytes: int | None = None, packed: bool = False, skip_if_exists: bool = False, per_file: bool = False) -> int:
    """Strings or binary values appended, in order, to the file that their row names; the number of values.

    A name may hold folders. With most_bytes a name's values go to name-00000, name-00001, ...
    of at most so many bytes (a larger value has a file of its own), written side by side, so a
    hot name is no single task's work; without it each name is one file that one task streams.
    A null value is empty, a null name an error.
    """
    if _finished(path, skip_if_exists, per_file):
        return 0
    keep, end = skip_if_exists and per_file, ".gz" if packed else ""
    named = F.coalesce(F.col(name).cast("string"), F.raise_error(F.lit("a row has no file name")).cast("string"))
    value = F.coalesce(_data(data, df, False), F.lit(b""))
    if most_bytes is None:
        rows = df.select(named.alias("file"), value.alias("data"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        keys = ["file", *[f"o{i}" for i in range(len(order))], "data"]
        return _complete(path, _write(rows.repartition("file").sortWithinPartitions(*keys).select("file", "data"), path, lambda file: file + end, packed, keep))

    def name_of(file: str) -> str:
        own, _, number = file.rpartition("\t")
        return f"{own}-{int(number):05d}{end}"

    return _complete(path, _save_bins(df, named, order, value.alias("data"), F.octet_length("data"), path, most_bytes, name_of, packed, keep))


def save_splits(df: DataFrame, column: str, path: str, order: list[str], most: int, by: str = "bytes", group: str | None = None, packed: bool = False, skip_if_exists: bool = False, per_file: bool = False) -> int:
    """Lines in order as files split-NNNNN of at most `most` bytes (line feeds included) or lines; the number of lines.

    With group the lines of a group, which are ordered by it first, are never parted: whole
    groups fill a file, and a group above `most` has one of its own.
    """
    if _finished(path, skip_if_exists, per_file):
        return 0
    keep, end = skip_if_exists and per_file, ".txt.gz" if packed else ".txt"
    data, cost = _data(column, df, True), F.octet_length("data") if by == "bytes" else F.lit(1)
    name_of = lambda file: f"split-{int(file.rpartition(chr(9))[2]):05d}{end}"
    if group is None:
        return _complete(path, _save_bins(df, F.lit(""), order, data, cost, path, most, name_of, packed, keep))
    rows = df.select(F.col(group).alias("group"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], data)
    sizes = rows.groupBy("group").agg(F.sum(cost).alias("cost"))
    numbered = stored(layout.dense_ids(sizes, ["group"], "id"), "groups")
    bins = layout.budget_bins(numbered, "id", "cost", most).select(F.col("ord").alias("id"), "bin")
    placed = numbered.join(bins, "id").select(F.col("group").alias("key"), "id", F.col("bin").cast("string").alias("file"))
    filed = rows.join(placed, F.col("group").eqNullSafe(F.col("key")))
    keys = ["file", "id", *[f"o{i}" for i in range(len(order))], "data"]
    return _complete(path, _write(filed.repartition("file").sortWithinPartitions(*keys).select("file", "data"), path, name_of, packed, keep))
