"""CDX files: text with one capture a line, plain or blocked and indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcframe.operators import cdx
from arcframe.sources import indexed, lines


def load(spark: SparkSession, path: str) -> DataFrame:
    """CDX columns of the lines of text files, compressed ones included."""
    return cdx.parse(lines.read_lines(spark, path), "line")


def save(captures: DataFrame, path: str, parts: int | None = None) -> None:
    """Gzip text files, sorted by key and time; each file is a range of the key."""
    n = parts or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = captures.repartitionByRange(n, "surt").sortWithinPartitions("surt", "ts14")
    lines.save_text(ranged.select(cdx.line().alias("line")), "line", path, gzip=True)


def save_indexed(captures: DataFrame, path: str, block_lines: int = indexed.BLOCK_LINES) -> None:
    indexed.write_indexed(captures.select(F.col("surt").alias("key"), cdx.line().alias("line")), path, block_lines)


def scan(spark: SparkSession, path: str, prefixes: DataFrame) -> DataFrame:
    """CDX columns and `matched` of captures whose key begins with a prefix, by the index."""
    found = indexed.scan(spark, path, prefixes)
    return cdx.parse(found, "line", "matched")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "surt") -> DataFrame:
    """(looked_up, CDX columns) of the captures of each key, by the index; none of them: no row."""
    found = indexed.lookup(spark, path, keys, key).where("line is not null")
    return cdx.parse(found, "line", "key").withColumnRenamed("key", "looked_up")
