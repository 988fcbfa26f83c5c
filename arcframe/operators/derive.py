"""Derivatives: language by text blocks, entity sets, piped commands."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frequent words by language, for the default detector.
STOP_WORDS = {
    "de": ("der", "die", "und", "ein", "das", "nicht", "mit", "von"),
    "en": ("the", "and", "of", "to", "that", "is", "was", "with"),
    "es": ("el", "que", "los", "una", "por", "para", "del", "las"),
    "fr": ("le", "les", "des", "est", "une", "dans", "pour", "qui"),
}
LEAST_TERMS = 10


def stop_word_language(tokens: Column) -> Column:
    """The language with most stop words among tokens; ties by name, null without any."""

    def hits(words: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*words)))

    # array_max takes the largest struct: most hits, and for ties the name with the largest inverted rank.
    names = sorted(STOP_WORDS)
    ranked = [F.struct(hits(STOP_WORDS[name]).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("lang")) for i, name in enumerate(names)]
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["lang"])


def merged_blocks(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, block, tokens): blocks of LEAST_TERMS terms or more, and runs of shorter ones as one block.

    Blocks without a term are left out before; merged ones that are still short go.
    """
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}0-9]+"), lambda t: t != "")
    sized = blocks.select(key, order, tokens.alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    w = Window.partitionBy(key).orderBy(order)
    joins_last = (F.col("n") < LEAST_TERMS) & (F.lag("n").over(w) < LEAST_TERMS)
    numbered = sized.withColumn("new", F.when(joins_last, 0).otherwise(1)).withColumn("block", F.sum("new").over(w))
    merged = numbered.groupBy(key, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return merged.where(F.size("tokens") >= LEAST_TERMS)


def block_languages(docs: DataFrame, key: str, text: str, detect: Callable[[Column], Column] = stop_word_language) -> DataFrame:
    """(key, lang, share): languages of the merged line blocks, weighted by terms squared.

    Blocks whose language is not recognised count in the total. detect maps a token array to
    a language or null.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    weight = F.pow(F.size("tokens").cast("double"), F.lit(2))
    marked = merged_blocks(lines, key, "line_no", "line").select(key, detect(F.col("tokens")).alias("lang"), weight.alias("weight"))
    by = marked.groupBy(key, "lang").agg(F.sum("weight").alias("weight"))
    total = by.groupBy(key).agg(F.sum("weight").alias("total"))
    return by.join(total, key).where("lang is not null").select(key, "lang", (F.col("weight") / F.col("total")).alias("share"))


ENTITIES = "locations array<string>, organizations array<string>, persons array<string>"


def entity_sets(docs: DataFrame, text: str, recognise: Callable[[str], dict[str, list[str]]], most_chars: int = 0) -> DataFrame:
    """docs with `entities`: sorted distinct names of three kinds.

    recognise is the caller's recogniser; an error of it gives empty sets. Texts are cut to
    most_chars where that is above 0.
    """

    @F.pandas_udf(ENTITIES)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                found = recognise((t or "")[: most_chars or None])
            except Exception:
                found = {}
            rows.append([sorted(set(found.get(k, ()))) for k in ("locations", "organizations", "persons")])
        return pd.DataFrame(rows, columns=["locations", "organizations", "persons"])

    return docs.withColumn("entities", find(F.col(text)))


def gazetteer(names: dict[str, dict[str, None]]) -> Callable[[str], dict[str, list[str]]]:
    """A recogniser that finds listed words."""
    known = {kind: set(words) for kind, words in names.items()}
    return lambda text: {kind: [w for w in text.split() if w in words] for kind, words in known.items()}


def pipe(df: DataFrame, column: str, command: str, name: str = "piped", timeout: int = 600) -> DataFrame:
    """df with the lines that a shell command gives, one per input line, a process a batch.

    White space in a value is one space on input. A failed command, or another number of
    lines than went in, fails the task.
    """
    schema = df.select("*", F.lit("").alias(name)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lines = "".join(" ".join(str(v or "").split()) + "\n" for v in frame[column])
            done = subprocess.run(["bash", "-c", command], input=lines, capture_output=True, text=True, timeout=timeout)
            out = done.stdout.split("\n")[:-1]
            if done.returncode or len(out) != len(frame):
                raise RuntimeError(f"command gave code {done.returncode} and {len(out)} of {len(frame)} lines: {done.stderr[-500:]}")
            yield frame.assign(**{name: out})

    return df.mapInPandas(run, schema)
