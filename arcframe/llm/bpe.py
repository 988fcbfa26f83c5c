"""BPE encoding and decoding with forced-boundary splitting (see fragments)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import lean
from arcframe.llm.fragments import SLICE_BYTES, Coder, forced_cuts, kept_coder, slices, token_bytes


def _token_table(path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes of all tokens, begin and size of those of each id)."""
    bodies = token_bytes(path)
    sizes = np.zeros(max(bodies) + 1, np.int64)
    sizes[list(bodies)] = [len(b) for b in bodies.values()]
    return b"".join([bodies.get(i, b"") for i in range(len(sizes))]), np.cumsum(sizes) - sizes, sizes


def _decoded(ids: np.ndarray, edges: np.ndarray, table: tuple[bytes, np.ndarray, np.ndarray]) -> pa.Array:
    """The text of each row of ids; bytes that are no UTF-8 are replaced."""
    body, begin, size = np.frombuffer(table[0], np.uint8), table[1][ids], table[2][ids]
    stop = np.cumsum(size)
    flat = body[np.repeat(begin - stop + size, size) + np.arange(int(size.sum()))]
    ends = np.append(0, stop)[edges].astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in texts.to_pylist()], pa.string())


def _texts(column: pa.Array) -> pa.Array:
    return column.fill_null("") if column.null_count else column


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids array<int> of each whole text. vocabulary: a byte-level BPE file.

    A null or empty text has no ids. Rows are independent: repeats and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary, cut)
        for batch in lean(batches):
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                ids, edges = coder.ids(_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))], names=[id_col, "ids"])

    cut = forced_cuts(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """id_col and text of each row of ids; special tokens are written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = token_bytes(vocabulary)
        for batch in lean(batches):
            texts = [b"".join([bodies[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def coded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row: id_col, ids array<int>, text (decoded from these ids).

    Encodes and decodes each whole text in one pass over the table, without a shuffle; a
    worker holds the fragments of 1 MB of text at a time, of 2 MB with keep. A null text is encoded
    as an empty one. With keep, workers hold their table of fragments between tasks; else each
    task makes one anew: workers outlive a stage, and what they keep counts against the next ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_coder(vocabulary, cut.tobytes()) if keep else Coder(vocabulary, cut)
        for batch in lean(batches):
            for lo, hi in slices(batch.column(1), size):
                part = batch.slice(lo, hi - lo)
                ids, edges = coder.ids(_texts(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, _decoded(ids, edges, table)], names=[id_col, "ids", "text"])

    size = SLICE_BYTES if keep else SLICE_BYTES // 2
    cut, table = forced_cuts(vocabulary), _token_table(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, text string")


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Figures of coded() rows: id_col, n_tokens, ids_sha256 (of the comma-joined ids), decoded_sha256."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and the decoded text of each row."""
    return digests(coded(docs, vocabulary, id_col, text_col, keep=True), id_col)
