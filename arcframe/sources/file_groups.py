"""Files as the unit of work: groups of files, partitions that a user names, split and merge.

Only names and sizes of files are planned on the driver, as any file listing is. Lines are
read by tasks, one after another, and no file or group is held as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arcframe.operators import layout
from arcframe.session import stored
from arcframe.sources import indexed, text_ranges
from arcframe.sources.ranges import CHUNK, Ranged, list_files
from arcframe.sources.routed import WRITTEN, WholeFile, batch_of, found

MOST_ROWS = 10_000


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, number) of the files of a path, numbered in the order of their names."""
    rows = [(file, size, i) for i, (file, size) in enumerate(list_files(path))]
    return spark.createDataFrame(rows, "file string, size long, number long")


def file_groups(spark: SparkSession, path: str, group: Column | None = None, files: int = 1) -> DataFrame:
    """(bin, group, file, size, number): files by a group (an expression over file and size), else runs of `files` files.

    Groups are numbered in their order; files without a group are one group.
    """
    every = listed(spark, path).withColumn("group", F.floor(F.col("number") / files).cast("string") if group is None else group.cast("string"))
    bins = layout.dense_ids(every.select("group").distinct(), ["group"], "bin").withColumnRenamed("group", "key")
    return every.join(bins, F.col("group").eqNullSafe(F.col("key"))).drop("key")


def load_groups(spark: SparkSession, path: str, group: Column | None = None, files: int = 1) -> DataFrame:
    """(group, file, offset, within, line): lines of each group, file by file in the order of names, a partition a group."""
    groups = stored(file_groups(spark, path, group, files), "file-groups")
    folder = indexed.new_folder(spark, "plan")
    groups.select("bin", F.col("number").alias("part"), "file", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end")).write.parquet(folder)
    text_ranges.register(spark)
    lines = spark.read.format("text_ranges").option("plan", folder).load()
    names = groups.select(F.col("bin").alias("range"), "group").distinct()
    # One short row a group of files.
    return lines.join(F.broadcast(names), "range").select("group", "file", "offset", "within", "line")


def load_partitions(spark: SparkSession, path: str, partitions: Column, load: Callable[[str, object], Iterator[tuple]], schema: str) -> DataFrame:
    """(file, partition, fields of schema): the rows that load(file, partition) gives for each of a file's partitions.

    partitions is an array over file and size. Each (file, partition) is read on its own, by
    whichever task it is dealt to; a file with an empty or null array has no rows.
    """
    units = listed(spark, path).select("file", F.explode(partitions).alias("partition"))
    fields = StructType.fromDDL(schema)
    names = ["file", "partition", *fields.names]
    whole = StructType([*units.schema.fields, *fields.fields])
    width = max(1, min(units.count(), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, number in zip(frame["file"], frame["partition"]):
                rows = []
                for row in load(file, number):
                    rows.append((file, number, *row))
                    if len(rows) == MOST_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return units.repartition(width, "file", "partition").mapInPandas(run, whole)


def even_splits(split_bytes: int) -> Column:
    """A file's ranges of split_bytes bytes, as an array over size; an empty file has one."""
    begins = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("size") - 1), F.lit(split_bytes).cast("long"))
    return F.transform(begins, lambda b: F.struct(b.alias("begin"), (b + split_bytes).alias("end")))


def split_and_merge(spark: SparkSession, path: str, out: str, run: Callable[[Iterator[bytes]], Iterator[bytes]], splits: Column | None = None, work: str | None = None, packed: bool = False) -> DataFrame:
    """Runs a function over the lines of each split of each file, and joins the results of a file in order; (file, rows, bytes).

    splits: array<struct<begin,end>> over file and size (default: ranges of SPLIT_BYTES); a
    line belongs to the split in which it begins. Results of splits are files of their own in
    `work`; with a folder given there, a run that was broken off passes over those that are whole.
    A merged file is streamed by one task under the input's name below the folder of all inputs.
    """
    every = listed(spark, path)
    bare = [file.partition("://")[2] for file, _ in list_files(path)]
    root = os.path.commonpath([os.path.dirname(x) for x in bare]) if bare else ""
    folder = work or indexed.new_folder(spark, "splits")
    pieces = every.select("file", F.posexplode(splits if splits is not None else even_splits(text_ranges.SPLIT_BYTES)).alias("at", "split"))
    pieces = pieces.select("file", "at", "split.begin", "split.end")

    def below(file: str) -> str:
        return os.path.relpath(file.partition("://")[2], root)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, at, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                target, rows, size = f"{folder}/{below(file)}/{at:08d}", 0, 0
                if not found(target):
                    f, piece = Ranged(file), WholeFile(target, packed)
                    try:
                        for line in run(x for *_, x in text_ranges.lines(f, begin, end)):
                            piece.write(line + b"\n")
                    finally:
                        f.close()
                    piece.close()
                    rows, size = piece.rows, piece.bytes
                yield batch_of([(f"{file}\t{at:08d}", rows, size)])

    width = max(1, min(pieces.count(), int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    done = stored(pieces.repartition(width, "file", "at").mapInArrow(process, WRITTEN), "splits")
    parts = done.select(F.substring_index("file", "\t", 1).alias("file"), F.substring_index("file", "\t", -1).alias("at"), "rows")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, target, rows = None, None, 0
        for batch in batches:
            for file, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if file != own:
                    if target is not None:
                        target.close()
                        yield batch_of([(own, rows, target.bytes)])
                    own, target, rows = file, WholeFile(f"{out}/{below(file)}", False), 0
                rows += n
                f, place = Ranged(f"{folder}/{below(file)}/{at}"), 0
                try:
                    while place < f.size:
                        body = f.read(place, CHUNK)
                        target.write(body)
                        place += len(body)
                finally:
                    f.close()
        if target is not None:
            target.close()
            yield batch_of([(own, rows, target.bytes)])

    return stored(parts.repartition("file").sortWithinPartitions("file", "at").mapInArrow(merge, WRITTEN), "merged")
