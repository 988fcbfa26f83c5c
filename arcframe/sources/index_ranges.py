"""Work planned from the block index of sorted text alone: ranges of whole key groups, samples, merge joins.

Only index rows (one a block) are shuffled or collected into cuts; lines are read by the task
that works on them, block by block, and a block at a border is read by the tasks of both sides.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcframe.operators.joins import following
from arcframe.operators.layout import in_ranges
from arcframe.sources.indexed import read_index
from arcframe.sources.ranges import Ranged

BATCH_LINES = 1 << 14


def _totals(index: DataFrame, order: list[str]) -> DataFrame:
    """Index rows in a global order with `before`, the lines of all blocks ahead."""
    ranged = in_ranges(index, order)
    sizes = ranged.groupBy("__part").agg(F.sum("lines").alias("__lines"))
    starts = sizes.select("__part", (F.sum("__lines").over(Window.orderBy("__part")) - F.col("__lines")).alias("__start"))
    within = F.sum("lines").over(Window.partitionBy("__part").orderBy("__pos")) - F.col("lines")
    return ranged.withColumn("__within", within).join(F.broadcast(starts), "__part").withColumn("before", F.col("__start") + F.col("__within")).drop("__part", "__pos", "__start", "__within")


def cuts(index: DataFrame, n: int, group: Callable[[Column], Column] = lambda key: key) -> list[str]:
    """At most n - 1 groups, in order, where a new partition begins, so that lines are near equal.

    group gives the part of a key that stays together; it must keep the order of keys. A
    partition begins with the group of the first block behind each n-th of the lines.
    """
    placed = _totals(index, ["key", "offset"]).withColumn("__slot", F.floor(F.col("before") * n / F.lit(max(1, index.agg(F.sum("lines")).first()[0] or 0))))
    first = placed.where("__slot > 0").groupBy("__slot").agg(F.min(group(F.col("key"))).alias("cut"))
    least = index.agg(F.min(group(F.col("key"))).alias("least")).first()[0]
    return sorted({r["cut"] for r in first.collect()} - {least}, key=str.encode)


def _number(key: Column, borders: list[str]) -> Column:
    """The number of borders at or below a group."""
    return F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<string>"), lambda b: b <= key)) if borders else F.lit(0)


def blocks_of_partitions(index: DataFrame, borders: list[str], group: Callable[[Column], Column]) -> DataFrame:
    """Index rows with `partition`, one row for each partition that a block can have lines of."""
    reach = F.lead("key").over(Window.partitionBy("part").orderBy("key", "offset"))
    spans = index.withColumn("__next", reach)
    low = _number(group(F.col("key")), borders)
    # A part's last block may reach to any later key.
    high = F.when(F.col("__next").isNull(), F.lit(len(borders))).otherwise(_number(group(F.col("__next")), borders))
    return spans.withColumn("partition", F.explode(F.sequence(low, F.greatest(low, high)))).drop("__next")


def _lines(f: Ranged, offset: int, length: int) -> Iterator[tuple[str, str]]:
    for line in zlib.decompress(f.read(offset, length), 31).decode().split("\n")[:-1]:
        key, _, rest = line.partition("\t")
        yield key, rest


def _stream(blocks: list[tuple[str, int, int]]) -> Iterator[tuple[str, str]]:
    """Lines of blocks in order; one file is open and one block held at a time."""
    f, name = None, None
    for path, offset, length in blocks:
        if path != name:
            if f is not None:
                f.close()
            f, name = Ranged(path), path
        yield from _lines(f, offset, length)
    if f is not None:
        f.close()


def _dealt(blocks: DataFrame, n: int) -> DataFrame:
    columns = ["partition", "side", "file", "offset", "length"]
    return blocks.repartitionById(n, F.col("partition")).sortWithinPartitions("partition", "side", "key", "offset").select(*columns)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """(partition, side -> its blocks in order); a partition's block list is small."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for number, own in groupby(rows, key=lambda r: r[0]):
        sides: dict[int, list] = {}
        for _, side, *block in own:
            sides.setdefault(side, []).append(tuple(block))
        yield number, sides


def range_partitions(spark: SparkSession, path: str, n: int, group: Callable[[Column], Column] = lambda key: key) -> DataFrame:
    """(partition, key, line): lines in at most n partitions of whole groups and near-equal size, each sorted by key."""
    index = read_index(spark, path)
    borders = cuts(index, n, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, sides in _tasks(batches):
            held = []
            for pair in _stream(sides[0]):
                held.append((number, *pair))
                if len(held) == BATCH_LINES:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)

    blocks = blocks_of_partitions(index, borders, group).withColumn("side", F.lit(0))
    lines = _dealt(blocks, len(borders) + 1).mapInArrow(run, "partition int, key string, line string")
    return lines.where(_number(group(F.col("key")), borders) == F.col("partition"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    number, key, line = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(key, pa.string()), pa.array(line, pa.string())], names=["partition", "key", "line"])


def sample(spark: SparkSession, path: str, n: int, seed: int = 0) -> DataFrame:
    """(place, key, line) of n lines (all, where there are fewer), the same ones for a seed however the lines are laid out.

    Line numbers are drawn in strata, one from each n-th of the lines; only the blocks that
    hold a drawn line are read.
    """
    index = read_index(spark, path)
    placed = _totals(index, ["key", "part", "offset"])
    total = index.agg(F.sum("lines")).first()[0] or 0
    n = min(n, total)
    low = lambda i: F.floor(i * F.lit(total) / F.lit(max(1, n)))
    width = low(F.col("id") + 1) - low(F.col("id"))
    drawn = spark.range(n).select((low(F.col("id")) + F.pmod(F.xxhash64(F.lit(seed), "id"), F.greatest(F.lit(1), width))).cast("long").alias("place"))
    ends = placed.where("lines > 0").select(F.lit(0).alias("lane"), (F.col("before") + F.col("lines") - 1).cast("long").alias("place"), "file", "offset", "length", "before")
    found = following(ends, drawn.withColumn("lane", F.lit(0)), ["lane"], "place", ["file", "offset", "length", "before"])
    wanted = found.groupBy("file", "offset", "length", "before").agg(F.sort_array(F.collect_list("place")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, length, before, places in zip(*(c.to_pylist() for c in batch.columns)):
                f = Ranged(path)
                own = list(_lines(f, offset, length))
                f.close()
                pairs = [own[p - before] for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([k for k, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string())], names=["place", "key", "line"])

    return wanted.mapInArrow(run, "place long, key string, line string")


def cogroup(spark: SparkSession, left: str, right: str, n: int) -> DataFrame:
    """(key, left, right): the lines of each key in two sorted folders, as arrays.

    The left index gives n ranges of the key; a task reads just the blocks of both sides that
    its range can have lines of, and merges them as they come. No line is shuffled.
    """
    one, two = read_index(spark, left), read_index(spark, right)
    borders = cuts(one, n)
    bounds = [None, *borders, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, sides in _tasks(batches):
            low, high = bounds[number], bounds[number + 1]
            inside = lambda k: (low is None or k.encode() >= low.encode()) and (high is None or k.encode() < high.encode())  # noqa: B023, E731
            keyed = [groupby((x for x in _stream(sides.get(side, [])) if inside(x[0])), key=lambda x: x[0]) for side in (0, 1)]
            heads = [next(g, None) for g in keyed]
            held = []
            while heads[0] or heads[1]:
                key = min((h[0] for h in heads if h), key=str.encode)
                row = [key, [], []]
                for side in (0, 1):
                    if heads[side] and heads[side][0] == key:
                        row[1 + side] = [x for _, x in heads[side][1]]
                        heads[side] = next(keyed[side], None)
                held.append(row)
                if len(held) == BATCH_LINES:
                    yield _groups(held)
                    held = []
            if held:
                yield _groups(held)

    whole = lambda key: key
    blocks = [blocks_of_partitions(x, borders, whole).withColumn("side", F.lit(i)) for i, x in enumerate((one, two))]
    return _dealt(blocks[0].unionByName(blocks[1]), len(borders) + 1).mapInArrow(run, "key string, left array<string>, right array<string>")


def _groups(rows: list) -> pa.RecordBatch:
    keys, left, right = zip(*rows)
    kind = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(left, kind), pa.array(right, kind)], names=["key", "left", "right"])
