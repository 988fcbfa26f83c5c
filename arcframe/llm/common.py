"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcframe.session import shared_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/arcframe-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they are; before the next one and at the end, what is no longer used goes back to the system.

    Workers outlive their tasks, so what Arrow's pool and the C library keep counts against all
    later stages: both give it back, the library (which holds freed texts, words and arrays) once a task.
    """
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
    gc.collect()
    trim()


def trim() -> None:
    """Gives memory that the C library and Arrow hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def lean_group(make):
    """make(rows) for applyInPandas; what groups before no longer use first goes back to the system."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        return make(rows)

    return run


def lean_pair(make):
    """As lean_group, for make(left, right) of cogroups."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trim()
        return make(left, right)

    return run


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch in a stage on whole texts.
TEXT_ROWS = 2_048


def text_batches(stage):
    """stage(spark, ...) in a session whose Arrow batches hold TEXT_ROWS rows at most.

    A batch is held by the JVM as it is built, as it comes back, and by the worker, in each task of
    an executor. The setting stays, as the stage's rows are made later.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, *args):
        if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXT_ROWS:
            spark.conf.set(BATCH_ROWS, str(TEXT_ROWS))
        return stage(spark, *args)

    return run


def rested(stage):
    """stage(spark, ...) in executors that gave back what the stages before no longer use.

    A heap grows to its limit with garbage that no collection of young objects finds, and keeps it: that counts
    against an executor beside the workers of the stage. A full collection lets it shrink; one task a core asks for it.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, *args):
        tasks = spark.sparkContext.defaultParallelism
        spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
        return stage(spark, *args)

    return run


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def without_ascii_space(text: Column) -> Column:
    """text without the characters [\\x20\\x09-\\x0D]; byte-wise replaces stay in codegen."""
    for ch in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: Masks of the first 0 to 8 bytes of a little-endian word; words of a run that are hashed side by side.
HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
RUN_WORDS = 32


def _words(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the runs that reach it, their j-th eight bytes) for the first RUN_WORDS places j."""
    wide = np.ndarray((len(codes) + 1,), "<u8", np.append(codes, np.zeros(8, np.uint8)), strides=(1,))
    live = np.flatnonzero(sizes > 0)
    for j in range(RUN_WORDS):
        if not len(live):
            return
        yield live, wide[starts[live] + 8 * j] & HEAD[np.minimum(sizes[live] - 8 * j, 8)]
        live = live[sizes[live] > 8 * j + 8]


def run_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; every byte and its place count."""
    out = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for live, body in _words(codes, starts, sizes):
            out[live] = mix64(out[live] * np.uint64(0xD6E8FEB86659FD93) + body)
        for i in np.flatnonzero(sizes > 8 * RUN_WORDS):
            raw = hashlib.blake2b(codes[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(raw, "<u8")[0]
    return out


def same_runs(codes: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the bytes of each run that begins at one are those that begin at two."""
    for (_, left), (_, right) in zip(_words(codes, one, sizes), _words(codes, two, sizes)):
        if not np.array_equal(left, right):
            return False
    long = np.flatnonzero(sizes > 8 * RUN_WORDS)
    return all(np.array_equal(codes[one[i] : one[i] + sizes[i]], codes[two[i] : two[i] + sizes[i]]) for i in long)


def fresh_name(df: DataFrame, stem: str) -> str:
    """stem, or stem with a number where df has a column of that name in any case."""
    taken, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}{n}"
    return name


def text_bytes(column) -> Iterator[bytes]:
    """UTF-8 bytes of each value of an Arrow string column; null is empty."""
    for lo in range(0, len(column), 128):
        for value in column.slice(lo, 128).cast(pa.large_binary()).to_pylist():
            yield value or b""
