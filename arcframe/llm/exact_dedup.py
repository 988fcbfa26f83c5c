"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Source blocks (65,536 rows of a scan partition at most) sort the fingerprints of their
   texts, cut the fingerprint range into owners and send each owner one Rice-coded run.
2. Owners decode the runs, find the fingerprints that came from several blocks or twice
   from one, and answer with a bitmap over each run.
3. Blocks turn the bitmaps into one mark per row. A row whose fingerprint does not match
   its mark (the input was dealt differently when read again) counts as a suspect, so a
   mark can never hide a copy.
4. Only suspects send their text: a hash aggregate keyed by digest and whole normalised
   text compares the bytes. Map-side partial aggregation folds large groups of copies
   before the shuffle.

A fingerprint has log2(rows) + 12 bits, so about one lone row in 4,096 is a false suspect;
that costs a text shuffle of the row and never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcframe.llm import golomb
from arcframe.llm.common import shuffle_width, without_ascii_space, written

BLOCK_BITS = 16
CHUNK_BITS = 8
MARK_BYTES = 4
#: Fingerprints that one owner holds at most, in the mean.
OWNER_ROWS = 1 << 19
#: Marks up to this size are broadcast; beyond it texts meet their marks in a shuffle.
BROADCAST_BYTES = 64 << 20

SENT = "block long, owner int, n int, k int, body binary, twice binary"
ANSWER = "block long, owner int, n int, k int, body binary, twice binary"
MARKS = "chunk long, marks array<int>"


def _sender(bits: int, owner_bits: int):
    """Fingerprint blocks -> Rice-coded runs by owner, and under owner -1 the block's own ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def close():
            raw = np.concatenate(parts)
            short = (raw.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            values, rank, counts = np.unique(short, return_inverse=True, return_counts=True)
            owner = values >> (bits - owner_bits)
            rows = [(block, -1, len(values), 0, rank.astype("<u2").tobytes(), (raw & 0x7FFFFFFF).astype("<i4").tobytes())]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(values)]):
                o = int(owner[lo])
                k = golomb.rice_parameter(1 << (bits - owner_bits), hi - lo)
                body = golomb.encode(values[lo:hi] - (o << (bits - owner_bits)), k)
                rows.append((block, o, hi - lo, k, body, np.packbits(counts[lo:hi] > 1).tobytes()))
            names = ("block", "owner", "n", "k", "body", "twice")
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            blocks = ids >> BLOCK_BITS
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if block is not None and blocks[lo] != block:
                    yield close()
                    parts = []
                block = int(blocks[lo])
                parts.append(prints[lo:hi])
        if parts:
            yield close()

    return run


def _receiver(rows: pd.DataFrame) -> pd.DataFrame:
    """The marks of one block: 31 bits of the fingerprint, then the duplicate bit."""
    own = rows[rows["owner"] < 0].iloc[0]
    answers = rows[rows["owner"] >= 0].sort_values("owner")
    bits = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(answers["twice"], answers["n"])])
    rank = np.frombuffer(own["body"], "<u2")
    marks = (np.frombuffer(own["twice"], "<i4") << 1) | bits[rank].astype(np.int32)
    first = int(own["block"]) << (BLOCK_BITS - CHUNK_BITS)
    step = 1 << CHUNK_BITS
    chunks = [marks[i : i + step] for i in range(0, len(marks), step)]
    return pd.DataFrame({"chunk": [first + i for i in range(len(chunks))], "marks": chunks})


def _keyed(docs: DataFrame, id_col: str, text_col: str, extra: list[Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = without_ascii_space(text)
    return (
        docs.select(F.col(id_col).alias("__af_id"), text.alias("__af_text"), norm.alias("__af_norm"), *extra, F.monotonically_increasing_id().alias("__af_row"))
        .withColumn("__af_sha", F.sha2("__af_norm", 256))
        .withColumn("__af_print", F.xxhash64("__af_sha"))
    )


def _marks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    spark = docs.sparkSession
    rows = docs.count()
    bits = min(60, max(1, rows).bit_length() + 12)
    owners = max(shuffle_width(spark), rows // OWNER_ROWS)
    owner_bits = min(bits - 1, max(1, (owners - 1).bit_length()))
    sent = written(
        _keyed(docs, id_col, text_col, []).select("__af_row", "__af_print").mapInArrow(_sender(bits, owner_bits), SENT), "fingerprints"
    )
    answers = sent.where("owner >= 0").groupBy("owner").applyInPandas(golomb.answered, ANSWER)
    marks = sent.where("owner < 0").unionByName(answers).groupBy("block").applyInPandas(_receiver, MARKS)
    return written(marks, "marks"), rows


def _suspects(docs: DataFrame, id_col: str, text_col: str, marks: DataFrame, rows: int, extra: list[Column]) -> DataFrame:
    """Every row with __af_suspect."""
    keyed = _keyed(docs, id_col, text_col, extra).withColumn("__af_chunk", F.shiftright("__af_row", CHUNK_BITS))
    own = marks.select(F.col("chunk").alias("__af_chunk"), F.col("marks").alias("__af_marks"))
    if rows * MARK_BYTES <= BROADCAST_BYTES:
        own = F.broadcast(own)
    mark = F.expr(f"try_element_at(__af_marks, cast(__af_row & {(1 << CHUNK_BITS) - 1} as int) + 1)")
    clear = ((mark.bitwiseAND(F.lit(1)) == 0) & (F.shiftrightunsigned(mark, 1) == F.col("__af_print").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))
    return keyed.join(own, "__af_chunk", "left").withColumn("__af_suspect", ~F.coalesce(clear, F.lit(False))).drop("__af_marks", "__af_chunk")


def _groups(suspects: DataFrame) -> DataFrame:
    """One row per verified group of suspects: digest, keeper and size."""
    verified = (
        suspects.groupBy("__af_sha", "__af_norm", F.char_length("__af_text").alias("__af_points"))
        .agg(F.min("__af_id").alias("__af_first"), F.count(F.lit(1)).alias("__af_n"))
        .select("__af_sha", F.char_length("__af_norm").alias("__af_len"), F.xxhash64("__af_norm").alias("__af_check"), "__af_points", "__af_first", "__af_n")
    )
    group = verified.groupBy("__af_sha").agg(
        F.min_by("__af_first", F.struct(-F.col("__af_points"), F.col("__af_first").isNull(), F.col("__af_first"))).alias("__af_keep"),
        F.sum("__af_n").alias("__af_size"),
        F.max("__af_len").alias("__af_len"),
        F.min("__af_check").alias("__af_lo"),
        F.max("__af_check").alias("__af_hi"),
    )
    clash = F.raise_error(F.lit("two different texts share one SHA-256 digest"))
    return group.withColumn("__af_size", F.when(F.col("__af_lo") == F.col("__af_hi"), F.col("__af_size")).otherwise(clash)).drop("__af_lo", "__af_hi")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without [\\x20\\x09-\\x0D]. The row with the most code
    points, then the smallest id, stays. A null text counts as empty; all empty texts are
    one group. A null id sorts after every other id; rows that repeat an id within a
    group share its decision. An empty table gives an empty result.
    """
    marks, rows = _marks(docs, id_col, text_col)
    every = _suspects(docs, id_col, text_col, marks, rows, [])
    groups = _groups(every.where("__af_suspect").select("__af_sha", "__af_norm", "__af_text", "__af_id"))
    # The length is part of the key so that both sides are dealt for this join alone: only then can AQE split a large group.
    lean = every.select("__af_id", "__af_sha", F.char_length("__af_norm").alias("__af_len"))
    keep = F.when(F.col("__af_size").isNull(), F.col("__af_id")).otherwise(F.col("__af_keep"))
    return lean.join(groups, ["__af_sha", "__af_len"], "left").select(
        F.col("__af_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__af_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__af_id").eqNullSafe(keep).alias("kept"),
        F.col("__af_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates() does not keep; columns as they were.

    Rows that repeat both id and text leave one row. Only suspects are shuffled.
    """
    marks, rows = _marks(docs, id_col, text_col)
    every = _suspects(docs, id_col, text_col, marks, rows, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__af_all")])
    suspects = every.where("__af_suspect")
    groups = _groups(suspects.select("__af_sha", "__af_norm", "__af_text", "__af_id"))
    keepers = groups.select(F.col("__af_sha").alias("__af_ks"), "__af_keep")
    match = (F.col("__af_sha") == F.col("__af_ks")) & F.col("__af_id").eqNullSafe(F.col("__af_keep"))
    single = suspects.select("__af_sha", "__af_id", "__af_all").join(keepers, match, "left_semi").dropDuplicates(["__af_sha", "__af_id"])
    return every.where("not __af_suspect").select("__af_all.*").unionByName(single.select("__af_all.*"))
