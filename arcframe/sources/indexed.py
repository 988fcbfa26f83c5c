"""Sorted, blocked text with an index, and reads of only the blocks that can matter.

A folder holds data/ (gzip files of blocks, each a member of its own) and index/ (a row a
block: part, key of its first line, file, offset, length, lines). Parts are ranges of the key.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcframe.operators import joins
from arcframe.session import shared_dir
from arcframe.sources.ranges import Ranged, open_system

INDEX = "part int, key string, file string, offset long, length long, lines long"
LINES = "key string, line string"
BLOCK_LINES, TOLERANCE = 3_000, 1 << 16
#: Bytes of near blocks that are read as one and by one task.
ISLAND_BYTES = 16 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arcframe-{name}-{uuid.uuid4().hex}"


def write_indexed(lines: DataFrame, path: str, block_lines: int = BLOCK_LINES, parts: int | None = None) -> None:
    """Writes (key, line) rows sorted by key, then line. Files of failed attempts have no index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = open_system(f"{path}/data")
        part, at, out, block = TaskContext.get().partitionId(), 0, None, []
        name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.gz"

        def flush() -> pa.RecordBatch:
            nonlocal at, out
            if out is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
            press = zlib.compressobj(6, zlib.DEFLATED, 31)
            body = press.compress("".join(f"{k}\t{x}\n" for k, x in block).encode()) + press.flush()
            out.write(body)
            row = [[part], [block[0][0]], [f"{path}/data/{name}"], [at], [len(body)], [len(block)]]
            at += len(body)
            block.clear()
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["part", "key", "file", "offset", "length", "lines"])

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.append(pair)
                if len(block) == block_lines:
                    yield flush()
        if block:
            yield flush()
        if out is not None:
            out.close()

    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = lines.select("key", "line").where("key is not null").repartitionByRange(n, "key").sortWithinPartitions("key", "line")
    ranged.mapInArrow(run, INDEX).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_blocks(blocks: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(key, line) of all lines in the ranges (file, offset, length); near ranges are read as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = Ranged(path)
                f.read(spans[0]["offset"], spans[-1]["offset"] + spans[-1]["length"] - spans[0]["offset"])
                for span in spans:
                    text = zlib.decompress(f.read(span["offset"], span["length"]), 31).decode()
                    pairs = [x.partition("\t") for x in text.split("\n")[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[2] for p in pairs], pa.string())], names=["key", "line"])
                f.close()

    w = Window.partitionBy("file").orderBy("offset")
    gap = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(w)
    marked = blocks.select("file", "offset", "length").distinct().withColumn("new", F.when(gap <= tolerance, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    # A broad prefix has all blocks of a file as neighbours: they are cut by their place.
    merged = marked.groupBy("file", "island", F.floor(F.col("offset") / ISLAND_BYTES)).agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("spans"))
    return merged.select("file", "spans").mapInArrow(run, LINES)


def blocks_of_prefixes(index: DataFrame, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Index rows whose block can hold a key that begins with one of the prefixes."""
    found = joins.index_candidates(index, "key", "part", prefixes, prefix).select("part", "key").distinct()
    return index.join(found, ["part", "key"], "left_semi")


def scan(spark: SparkSession, path: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(key, line, matched) of the lines whose key begins with a prefix; only candidate blocks are read."""
    lines = read_blocks(blocks_of_prefixes(read_index(spark, path), prefixes, prefix))
    return joins.prefix_match(lines, "key", prefixes, prefix, inner=True)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, line) for every distinct looked-up key: its lines, or one row with a null line.

    A block is read where a key lies at or behind its first key and before that of the next
    block, or is the next block's first key.
    """
    wanted = keys.select(F.col(key).alias("key")).where("key is not null").distinct()
    index = read_index(spark, path)
    spans = index.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key", "offset")))
    within = joins.adjacent(index, "key", wanted, "key")
    before = spans.join(wanted.select(F.col("key").alias("next_key")), "next_key", "left_semi").select(index.columns)
    return wanted.join(read_blocks(within.unionByName(before)), "key", "left")
