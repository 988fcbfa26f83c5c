"""A corpus pipeline: raw documents to token counts of a balanced, deduplicated mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. A stage
works on everything that its predecessor kept:

* toxicity: rows whose score reaches 0.5 go; null and empty texts score low and stay.
* exact_dedup: of texts equal without white space the longest original, then the smallest
  id, stays; all empty texts are one group.
* ngram_join: of every component of near duplicates the smallest id stays; texts without
  words link with nothing and stay.
* mixing: rows are sampled with the calibrated rate of their (source, lang, topic) cell;
  texts without words have no tokens and go.
* bpe: ids and decoded text of every row that is left, written as a table (tokens); the
  stage returns their numbers and digests, taken from that table.

Empty tables give empty results, rows with null ids count as rows of their own, and columns
beyond those of documents pass through the first four stages under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcframe.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from arcframe.llm.catalog import vocabulary
from arcframe.llm.common import read_table, rested, text_batches, written


@rested
@text_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@rested
@text_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


@rested
@text_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_duplicates(docs)


@rested
@text_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_mixture(docs)


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, ids and decoded text of every row, as a table in the shared folder."""
    return written(bpe.coded(docs, vocabulary("byte_bpe_50k.json")), "tokens")


@rested
@text_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(tokens(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


@text_batches
def run_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: ids and decoded text of every row that is left."""
    return tokens(_mixed(spark, sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: numbers and digests of the tokens."""
    return tokenize(spark, _mixed(spark, sf_dir), sf_dir)
