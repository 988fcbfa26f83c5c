"""Log-likelihood of whole documents under a gated recurrent language model trained on the corpus.

Words are counted over all training documents. The most frequent words of the corpus are the
network's tokens (gru.py), all others one token more, within which a word has its smoothed
share of the counts: the model is a distribution over all words, one unknown word included.

* counts: one pass, sums by word.
* encode: one pass; the counts of at most LOOKUP frequent words travel to the tasks, the words
  behind them meet their counts in a join. Ids are written as 16-bit integers.
* train: ROUNDS rounds over all training documents. In each, every shard trains from the same
  weights on its own documents; weights are then averaged block by block. Weights are of a
  fixed size; shards grow with the tokens up to MOST_SHARDS, beyond which each has more of them.
* score: one pass over the ids; a document's state is carried from window to window to its end.

Odd rows: a null text has its END alone; a null id counts as '' for the fold; repeated rows are
rows of their own; without training documents every token is unknown and the network untrained.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcframe.llm import gru
from arcframe.llm.common import lean, new_folder, written
from arcframe.sources.ranges import open_system

FOLDS, HELD_OUT = 5, 1
#: Words whose counts tasks hold, and the bytes of the longest of them: the size of what is sent is bounded.
LOOKUP, LOOKUP_BYTES = 1 << 17, 64
TOKENS, CLASSES = 4096, 40
REST = 1
ROUNDS, SHARD_TOKENS, MOST_SHARDS = 3, 4 << 20, 4096
POOL_TOKENS, SCORE_TOKENS = 2 << 20, 1 << 20
HELD_WORDS, HELD_BYTES = 1 << 18, 16 << 20
PIECE_BYTES, BLOCK_FLOATS = 4 << 20, 1 << 14


def words_of(text: str) -> Iterator[list[bytes]]:
    """Lower-case words between ASCII white space, in lists of about PIECE_BYTES of text."""
    data = text.encode().lower()
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def token_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; the row whose word is null counts the ENDs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = Counter(), 0, 0

        def flush(words: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for batch in lean(batches):
            for i in range(batch.num_rows):
                ends += 1
                for words in words_of(batch.column(0)[i].as_py() or ""):
                    held.update(words)
                size += batch.column(0)[i].as_buffer().size if batch.column(0)[i].is_valid else 0
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield flush(list(held), list(held.values()))
                    held, size = Counter(), 0
        if ends:
            yield flush([*held, None], [*held.values(), ends])

    return train.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Words whose counts are held, the most frequent first, and the figures of all words."""

    def __init__(self, words: list[str], counts: list[int], ends: int, total: int, distinct: int):
        self.words, self.counts, self.ends, self.total, self.distinct = words, np.array(counts, np.int64), ends, total, distinct
        self.short = min(len(words), TOKENS - 2)
        held = int(self.counts[: self.short].sum())
        #: Smoothed counts of all words that are no tokens, one unknown word included.
        self.rest = (total - ends - held) + 0.5 * (distinct - (ends > 0) - self.short) + 0.5
        self.base = total + 0.5 * (distinct + 1)

    def token_counts(self) -> np.ndarray:
        return np.array([self.ends + 0.5, self.rest, *(self.counts[: self.short] + 0.5)])

    def log_base(self, n) -> np.ndarray:
        return np.log10((n + 0.5) / self.base)

    def log_rest(self, n) -> np.ndarray:
        return np.log10((n + 0.5) / self.rest)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The figures of counted words and the frequent ones.

    They are the words at or above the least count (by sixteenths of its binary logarithm)
    that leaves at most LOOKUP of them.
    """
    total, distinct, ends = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    level = F.floor(F.log2("n") * 16)
    usable = counts.where(F.col("word").isNotNull() & (F.octet_length("word") <= LOOKUP_BYTES))
    least, room = None, LOOKUP
    for step, words in sorted(((r[0], r[1]) for r in usable.groupBy(level).count().collect()), reverse=True):
        if words > room:
            break
        least, room = step, room - words
    held = [] if least is None else usable.where(level >= least).collect()
    held = sorted(((r["word"], r["n"]) for r in held), key=lambda x: (-x[1], x[0].encode()))
    return Vocabulary([w for w, _ in held], [n for _, n in held], ends or 0, total or 0, distinct)


def save_file(folder: str, **arrays: np.ndarray) -> str:
    """Arrays as a file of the shared folder."""
    system, path = open_system(folder)
    system.create_dir(path, recursive=True)
    body = io.BytesIO()
    np.savez(body, **arrays)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{path}/{name}.npz", compression=None) as out:
        out.write(body.getvalue())
    return f"{folder}/{name}.npz"


def load_file(uri: str) -> dict[str, np.ndarray]:
    system, path = open_system(uri)
    with system.open_input_file(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


ENCODED = "{id} , n_tokens long, known long, base double, within double, ids binary, others array<struct<word:string, n:long>>"


@cache
def _numbers(uri: str) -> dict[bytes, int]:
    """word -> its place by frequency; kept by a worker between tasks (LOOKUP words at most)."""
    return {w: i for i, w in enumerate(load_file(uri)["words"].tobytes().split(b"\n")[:-1])}


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Per row: figures of its words whose counts are held, token ids, and its other words with their numbers."""
    blob = np.frombuffer("".join(w + "\n" for w in vocab.words).encode(), np.uint8)
    uri = save_file(new_folder(docs.sparkSession, "vocabulary"), words=blob, base=vocab.log_base(vocab.counts), rest=vocab.log_rest(vocab.counts))
    short, end_base = vocab.short, float(vocab.log_base(vocab.ends))
    end_known = int(vocab.ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tables = _numbers(uri), load_file(uri)
        base, rest = tables["base"], tables["rest"]
        get = numbers.get
        for batch in lean(batches):
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for text in part.column(1).to_pylist():
                    size, known, log_base, within, ids, others = 1, end_known, end_base, 0.0, [], Counter()
                    for words in words_of(text or ""):
                        found = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                        missing = np.flatnonzero(found < 0)
                        others.update([words[i] for i in missing])
                        have = found[found >= 0]
                        size, known = size + len(words), known + len(have)
                        log_base += float(base[have].sum())
                        within += float(rest[have[have >= short]].sum())
                        ids.append(np.where((found >= 0) & (found < short), found + 2, REST).astype("<u2").tobytes())
                    ids.append(np.uint16(gru.END).tobytes())
                    rows.append((size, known, log_base, within, b"".join(ids), [{"word": w.decode(), "n": n} for w, n in others.items()]))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_tokens", "known", "base", "within", "ids", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    coded = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, ENCODED.format(id=f"`{id_col}` {kind}"))
    return coded.withColumn("row", F.monotonically_increasing_id())


def _streams(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    """The ids of whole documents, in lists of about size tokens; the last two lists share what is left."""
    ready, texts, held = None, [], 0
    for batch in batches:
        for body in batch.column(0).to_pylist():
            texts.append(np.frombuffer(body, "<u2"))
            held += len(texts[-1])
            if held >= size:
                if ready is not None:
                    yield ready
                ready, texts, held = texts, [], 0
    if ready is not None and held < size // 2:
        ready, texts = ready + texts, []
    yield from (x for x in (ready, texts) if x)


def train(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, shards: int | None = None) -> str:
    """The path of the weights trained on all rows of coded ids, once."""
    spark = coded.sparkSession
    counts = vocab.token_counts()
    bounds = gru.class_bounds(counts, CLASSES)
    weights = gru.fresh(counts, bounds)
    flat, seen = gru.packed(weights), np.full(gru.packed(weights).size, 1e-6, np.float32)
    folder = new_folder(spark, "weights")
    uri = save_file(folder, flat=flat, seen=seen)
    width = shards or int(min(MOST_SHARDS, max(1, math.ceil(vocab.total / SHARD_TOKENS))))
    blocks = -(-flat.size // BLOCK_FLOATS)

    for turn in range(rounds if vocab.total else 0):

        def run(batches: Iterator[pa.RecordBatch], uri: str = uri) -> Iterator[pa.RecordBatch]:
            held = load_file(uri)
            own, sums = gru.unpacked(held["flat"], weights), gru.unpacked(held["seen"], weights)
            net, tokens = gru.Network(own, bounds), 0
            for texts in _streams(batches, POOL_TOKENS):
                stream = np.concatenate(texts).astype(np.int64)
                tokens += len(stream)
                net.train(stream, sums)
            if tokens:
                for name, values in (("flat", gru.packed(own)), ("seen", gru.packed(sums))):
                    parts = [values[i * BLOCK_FLOATS : (i + 1) * BLOCK_FLOATS] for i in range(blocks)]
                    arrays = [pa.array([name] * blocks), pa.array(range(blocks), pa.int32()), pa.array([tokens] * blocks, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["name", "block", "tokens", "body"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], list] = {}
            for batch in batches:
                for name, block, tokens, body in zip(*(c.to_pylist() for c in batch.columns)):
                    part = sums.setdefault((name, block), [0, 0.0])
                    part[0] += tokens
                    part[1] = part[1] + np.frombuffer(body, np.float32).astype(np.float64) * tokens
            for (name, block), (tokens, values) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([(values / tokens).astype(np.float32).tobytes()], pa.binary())], names=["name", "block", "body"])

        own = coded.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(rounds)) == turn).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(width)).cast("int"))
        trained = own.repartitionById(width, "shard").select("ids").mapInArrow(run, "name string, block int, tokens long, body binary")
        mean = trained.repartition("name", "block").mapInArrow(average, "name string, block int, body binary")
        bodies = {(r["name"], r["block"]): r["body"] for r in mean.collect()}
        if bodies:
            flat, seen = (np.frombuffer(b"".join(bodies[name, i] for i in range(blocks)), np.float32) for name in ("flat", "seen"))
            uri = save_file(folder, flat=flat, seen=seen)
    return uri


def network_scores(coded: DataFrame, vocab: Vocabulary, uri: str) -> DataFrame:
    """(row, neural): log10 probability of the tokens of each row."""
    counts = vocab.token_counts()
    bounds = gru.class_bounds(counts, CLASSES)
    like = gru.fresh(counts, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = gru.Network(gru.unpacked(load_file(uri)["flat"], like), bounds)
        rows, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            found = net.scores(texts) / math.log(10)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found)], names=["row", "neural"])

        for batch in lean(batches):
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append(row)
                texts.append(np.frombuffer(body, "<u2"))
                held += len(texts[-1])
                if held >= SCORE_TOKENS:
                    yield flush()
                    rows, texts, held = [], [], 0
        if rows:
            yield flush()

    return coded.select("row", "ids").mapInArrow(run, "row long, neural double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (network)."""
    counts = written(token_counts(docs.where(fold(id_col) != HELD_OUT), text_col), "counts")
    vocab = vocabulary(counts)
    coded = written(encode(docs, vocab, id_col, text_col).withColumn("held_out", fold(id_col) == HELD_OUT), "coded")
    weights = train(coded.where("not held_out"), vocab)

    base, rest = F.lit(float(vocab.base)), F.lit(float(vocab.rest))
    others = coded.select("row", F.explode("others").alias("x")).select("row", "x.word", F.col("x.n").alias("times"))
    met = others.join(counts.where("word is not null"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / base)).alias("more_base"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / rest)).alias("more_within"),
    )
    found = coded.drop("ids", "others").join(network_scores(coded, vocab, weights), "row").join(sums, "row", "left")
    plus = lambda one, more: F.col(one) + F.coalesce(more, F.lit(0))
    return found.select(
        id_col, "held_out", "n_tokens", plus("known", "more_known").cast("long").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), (F.col("neural") + plus("within", "more_within")).alias("score"),
    )
