"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on ids.

Documents are dealt by ranges of their id and written in ascending order, so a file and
its stripes cover a narrow span of ids: min/max statistics and the Bloom filters let a
reader skip stripes, and stripes can be read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcframe.llm.common import new_folder, shuffle_width
from arcframe.llm.fragments import Coder, forced_cuts, kept_coder, slices

#: Bytes of text that a task encodes at once.
SLICE_BYTES = 4 << 20
#: Places of a worker's table of fragments (two fragments of 22 bytes each); it is kept, so rare words are encoded once.
SLOTS = 1 << 20
ORC_OPTIONS = {
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
}


def _encoded(column: pa.Array, coder: Coder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one behind the other, end_id after each, and the edges of the texts."""
    ids, edges = coder.ids(column)
    return np.insert(ids, edges[1:], np.int32(end_id)), edges + np.arange(len(edges))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encodes every whole text, appends end_id and writes ORC files below path.

    Columns: id_col, shard, local_start (ids before the document in its shard), n_tokens,
    ids. A null text counts as empty and has the end id only. Rows that repeat an id are
    all written, in the order of their text's hash; null ids come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_coder(vocabulary, cut, SLOTS)
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(batch.column(1), SLICE_BYTES):
                ids, edges = _encoded(batch.column(1).slice(lo, hi - lo), coder, end_id)
                sizes = np.diff(edges)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, shard), pa.int32()),
                        pa.array(edges[:-1] + start),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)),
                    ],
                    names=[id_col, "shard", "local_start", "n_tokens", "ids"],
                )
                start += int(edges[-1])

    cut = forced_cuts(vocabulary).tobytes()
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    (
        docs.select(id_col, text.alias("__af_text"))
        .withColumn("__af_tie", F.xxhash64("__af_text"))
        .repartitionByRange(files or shuffle_width(docs.sparkSession), F.col(id_col), F.col("__af_tie"))
        .sortWithinPartitions(id_col, "__af_tie")
        .select(id_col, "__af_text")
        .mapInArrow(run, f"`{id_col}` {kind}, shard int, local_start long, n_tokens long, ids array<int>")
        .write.options(**ORC_OPTIONS)
        .option("orc.bloom.filter.columns", id_col)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as rows with the global start of each document.

    A filter on the id column reaches the stripes' statistics and Bloom filters. Shard
    sizes (one row a file) are summed in a window and broadcast: as many rows as files.
    """
    rows = spark.read.orc(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("__af_size"))
    before = F.sum("__af_size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("__af_base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("__af_base") + F.col("local_start")).drop("__af_base")


def token_table(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and reads them back: id_col, start, n_tokens, ids_crc32 (see write_tokens)."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values = np.ascontiguousarray(ids.values.to_numpy(), "<i4")
            edges = ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())],
                names=[id_col, "start", "n_tokens", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return read_tokens(spark, path).select(id_col, "start", "ids").mapInArrow(digest, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
