"""Groups of neighbouring rows with equal keys, over the borders of ranges and files.

Rows come in ranges that are read in order (text_ranges). A range tells its number of runs and
its first and last key: one row a range. Only these rows meet, which settles what run a range's
first run goes on with; the rows themselves are never shuffled. A task may read many ranges.

A null key belongs to no group and ends the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcframe.session import stored

#: A group's number: the range it begins in, and its run there.
RUNS_BITS = 40


def _starts(keys: pa.Array, last) -> np.ndarray:
    """Whether each row's key differs from that of the row before; `last` stands before the first."""
    before = pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, len(keys) - 1)])
    same = pc.fill_null(pc.equal(keys, before), False)
    both_null = pc.and_(pc.is_null(keys), pc.is_null(before))
    return pc.invert(pc.or_(same, both_null)).to_numpy(zero_copy_only=False)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(batch, its ranges, its keys, the run of each row within its range, whether a run begins there).

    The last column is the key, the one before the range.
    """
    at, run, last = None, -1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges, keys = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1)
        fresh = np.append(at is None or ranges[0] != at, ranges[1:] != ranges[:-1])
        starts = fresh | _starts(keys, last)
        counted = np.cumsum(starts)
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(ranges)), -1))
        runs = np.where(begun < 0, run + counted, counted - counted[begun])
        at, run, last = ranges[-1], int(runs[-1]), keys[len(keys) - 1].as_py()
        yield batch, ranges, keys, runs, starts


def _borders(rows: DataFrame, key: Column) -> DataFrame:
    """(range, opens): the number of the group that a range's first run goes on with, or null."""
    kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        kind = None
        for _, ranges, keys, runs, _ in _numbered(batches):
            kind = keys.type
            begins = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist()]
            for i, stop in zip(begins, [*begins[1:], len(ranges)]):
                own = found.setdefault(int(ranges[i]), [keys[i].as_py(), None, 0])
                own[1:] = [keys[stop - 1].as_py(), int(runs[stop - 1])]
        if found:
            columns = [[*found], *zip(*found.values())]
            kinds = (pa.int64(), kind, kind, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "first_key", "last_key", "runs"])

    return _opened(rows.select("range", key.alias("key")).mapInArrow(run, f"range long, first_key {kind}, last_key {kind}, runs long"))


def _opened(ends: DataFrame) -> DataFrame:
    """_borders() from (range, first_key, last_key, runs): the keys and the number of the last run of each range."""
    w = Window.orderBy("range")
    joined = F.coalesce(F.lag("last_key").over(w) == F.col("first_key"), F.lit(False))
    number = F.shiftleft("range", RUNS_BITS) + F.col("runs")
    marked = ends.withColumn("joined", joined).withColumn("own", F.when((F.col("runs") > 0) | ~F.col("joined"), number))
    last = marked.withColumn("last", F.last("own", ignorenulls=True).over(w))
    return last.withColumn("before", F.lag("last").over(w)).select("range", F.when(F.col("joined"), F.col("before")).alias("opens"))


def label_groups(rows: DataFrame, key: Column) -> DataFrame:
    """rows (in ranges) with `key` and `group`, the number of their group; rows without a key go.

    Two passes over the rows, none of which shuffles them: what is shuffled and broadcast is a
    row a range.
    """
    keyed = rows.select(*[c for c in rows.columns if c != "range"], "range", key.alias("key"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, runs, _ in _numbered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=[*batch.schema.names, "run"])

    numbered = keyed.mapInArrow(run, f"{kinds}, run long")
    own = F.shiftleft("range", RUNS_BITS) + F.col("run")
    placed = numbered.where("key is not null").join(F.broadcast(_borders(rows, key)), "range")
    return placed.select(*rows.columns, "key", F.when(F.col("run") == 0, F.coalesce("opens", own)).otherwise(own).alias("group"))


def whole_groups(rows: DataFrame, key: Column) -> DataFrame:
    """(group, key, rows, first): one row a whole group; first is the place (range, offset, within) of its first line.

    Runs are counted where they are read, once, and written to the shared folder, a row each;
    only the first and last run of a range are shuffled.
    """
    kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def counted(first: np.ndarray, more: int) -> list[pa.Array]:
            """The runs that begin at these rows of the batch."""
            n = np.diff(np.append(first, more))
            at = pa.array(first)
            return [pa.array(ranges[first]), pa.array(runs[first], pa.int64()), keys.take(at), pa.array(n, pa.int64()), batch.column(0).take(at), batch.column(1).take(at)]

        for batch, ranges, keys, runs, starts in _numbered(batches):
            first = np.flatnonzero(starts)
            before = int(first[0]) if len(first) else len(ranges)
            if held is not None and before:
                held[3] = pc.add(held[3], before)
            if not len(first):
                continue
            found = counted(first, len(ranges))
            done = [x.slice(0, len(first) - 1) for x in found]
            if held is not None:
                done = [pa.concat_arrays([x, y]) for x, y in zip(held, done)]
            held = [x.slice(len(first) - 1) for x in found]
            if len(done[0]):
                yield pa.RecordBatch.from_arrays(done, names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays(held, names=names)

    names = ["range", "run", "key", "rows", "offset", "within"]
    counts = rows.select("offset", "within", "range", key.alias("key")).mapInArrow(run, f"range long, run long, key {kind}, rows long, offset long, within long")
    runs = stored(counts, "runs")
    ends = runs.groupBy("range").agg(F.min_by("key", "run").alias("first_key"), F.max_by("key", "run").alias("last_key"), F.max("run").alias("runs"))
    own = F.shiftleft("range", RUNS_BITS) + F.col("run")
    placed = runs.where("key is not null").join(F.broadcast(_opened(ends)), "range")
    place = F.struct("range", "offset", "within")
    placed = placed.select(F.when(F.col("run") == 0, F.coalesce("opens", own)).otherwise(own).alias("group"), "key", "rows", place.alias("first"), (F.col("run") == 0).alias("head"))
    heads = placed.where("head").select("group").distinct()
    inner = placed.join(F.broadcast(heads), "group", "left_anti").select("group", "key", "rows", "first")
    border = placed.join(F.broadcast(heads), "group", "left_semi").groupBy("group").agg(F.first("key").alias("key"), F.sum("rows").alias("rows"), F.min("first").alias("first"))
    return inner.unionByName(border)
