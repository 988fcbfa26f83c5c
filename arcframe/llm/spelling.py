"""Spelling variants by a symmetric-delete join.

Words are counted over all whole texts. Every frequent word emits itself and its distinct
single deletions as keys; words that meet under a key are candidates, and those at a distance
of exactly one code point are near. A word's form is its most frequent near word if that is
RATIO times as frequent, and roots follow forms to their end by doubling.

Odd rows: a null text has no words; a null id is written as '' where words are varied; rows
that repeat count again; an empty table gives an empty result; further columns are ignored.
Ties of form go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import lean, mix64, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, RATIO, VARY = 6, 5, 5, 199
#: Distinct words and their bytes that a task holds before it hands on partial counts.
HELD_WORDS, HELD_BYTES = 1 << 18, 16 << 20
#: Code points whose keys are made at once (one word at least), and whose word is longer than usual.
KEY_CHARS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def varied(doc_id: str, run: bytes, vary: int = VARY) -> bytes:
    """A run in lower case, with one code point deleted where the crc32 of id and run tells so."""
    h = zlib.crc32(run, zlib.crc32(f"{doc_id}:".encode()))
    if h % vary:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vary: int = VARY) -> DataFrame:
    """(word, n) of the words of at least LEAST_CHARS code points and LEAST_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            size = 0
            return out

        for batch in lean(batches):
            for row in range(batch.num_rows):
                doc, text = batch.column(0)[row].as_py() or "", batch.column(1)[row].as_py()
                found = Counter(m[0] for m in RUN.finditer(text)) if text and len(text) > 1 << 20 else Counter(RUN.findall(text or ""))
                for run, n in found.items():
                    if len(run) < LEAST_CHARS:
                        continue
                    word = varied(doc, run.encode().lower(), vary)
                    if len(word) >= LEAST_CHARS:
                        if word not in held:
                            size += len(word)
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    sums = rows.groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_CHARS))


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, key) of each word and of its distinct single deletions.

    A key is a 64-bit hash of the string that is left: prefix sums of c[j] * B**j, those behind
    the deletion moved one place back. Equal strings have equal keys; unequal strings that
    share one cost a comparison.
    """
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(max(1, int(sizes.max())), _BASE, np.uint64)))
        values = mix64(codes.astype(np.uint64) + np.uint64(1)) * powers[place]
        sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        first, last = sums[starts], sums[starts + sizes]
        at = np.arange(len(codes))
        left = sums[at] - first[owner] + (last[owner] - sums[at + 1]) * np.uint64(_BACK)
        deleted = mix64(left + (sizes[owner] - 1).astype(np.uint64))
        own = mix64(last - first + sizes.astype(np.uint64))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    return np.append(np.arange(len(words)), owner[fresh]), np.append(own, deleted[fresh]).view(np.int64)


def near_pairs(words: DataFrame) -> DataFrame:
    """(one, two, n_one, n_two) of words (id, word, n) at a distance of exactly one, each pair once.

    Keys travel with 8-byte ids only, so long words cost their length and not its square. Words
    under a key differ at one place, so a key has at most as many as its length times the alphabet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo + 1, len(texts[lo])
                while hi < len(texts) and chars + len(texts[hi]) <= KEY_CHARS:
                    chars, hi = chars + len(texts[hi]), hi + 1
                owner, keys = delete_keys(texts[lo:hi])
                own = ids[lo:hi][owner]
                for a in range(0, len(keys), KEY_CHARS):
                    yield pa.RecordBatch.from_arrays([pa.array(own[a : a + KEY_CHARS], pa.int64()), pa.array(keys[a : a + KEY_CHARS])], names=["id", "key"])
                lo = hi

    keys = words.select("id", "word").mapInArrow(run, "id long, key long")
    candidates = keys.select(F.col("id").alias("one"), "key").join(keys.select(F.col("id").alias("two"), "key"), "key").where("one < two").select("one", "two").distinct()
    side = lambda name: words.select(F.col("id").alias(name), F.col("word").alias(f"w_{name}"), F.col("n").alias(f"n_{name}"))
    checked = candidates.join(side("one"), "one").join(side("two"), "two")
    return checked.where(F.levenshtein("w_one", "w_two", 1) == 1)


def follow(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, to) that form no cycle: each step doubles the distance followed."""
    held = written(links.select("id", F.col("to").alias("root")), "roots")
    while True:
        onward = held.select(F.col("id").alias("root"), F.col("root").alias("next"))
        held = written(held.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if held.where("moved").isEmpty():
            return held.select("id", "root")
        held = held.select("id", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: form, root, n, n_near, form_n (see above)."""
    numbered = word_counts(docs, id_col, text_col).withColumn("id", F.monotonically_increasing_id())
    words = written(numbered, "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select(F.col("one").alias("id"), F.struct((-F.col("n_two")).alias("n"), F.col("w_two").alias("word"), F.col("two").alias("id")).alias("near")).unionByName(
        pairs.select(F.col("two").alias("id"), F.struct((-F.col("n_one")).alias("n"), F.col("w_one").alias("word"), F.col("one").alias("id")).alias("near"))
    )
    best = both.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    joined = words.join(best, "id", "left")
    has = -F.col("best.n") >= RATIO * F.col("n")
    forms = written(
        joined.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n"), F.when(has, F.col("best.id")).alias("to")
        ),
        "forms",
    )
    roots = follow(forms.where("to is not null").select("id", "to"))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = forms.join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
