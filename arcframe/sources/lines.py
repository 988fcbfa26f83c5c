"""Text loaders and savers that keep files, line numbers and names in view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcframe.functions import charsets

MOST_LINE_CHARS = 1 << 20


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) with lines cut to MOST_LINE_CHARS and a trailing CR dropped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.substring("value", 1, MOST_LINE_CHARS).alias("line"))
    return lines.withColumn("line", F.regexp_replace("line", r"\r$", ""))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): each file is read whole, so numbers hold within it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    return files.select("file", F.posexplode("lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def chunks_of_lines(spark: SparkSession, path: str, size: int) -> DataFrame:
    """read_numbered with `chunk`: the line index within its file divided by size."""
    return read_numbered(spark, path).withColumn("chunk", F.floor(F.col("line_no") / size).cast("long"))


def read_binary(spark: SparkSession, path: str, unpack: bool = False) -> DataFrame:
    """(path, length, content) of whole files; unpack undoes gzip and zstd, told by the file's ending or first bytes. Empty files have no row."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return files.withColumn("content", charsets.unpack(F.col("content"), F.col("path"))) if unpack else files


def save_text(df: DataFrame, column: str, path: str, gzip: bool = False, overwrite: bool = False) -> None:
    """One text file a partition; committed as a whole with a _SUCCESS flag."""
    writer = df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def save_named(df: DataFrame, name: str, column: str, path: str, parts: int = 1) -> None:
    """Rows routed to folders by name, `parts` files a name so a large one is spread."""
    salted = df.select(F.col(name).alias("name"), F.col(column).cast("string").alias("value"))
    salted.withColumn("__salt", F.pmod(F.xxhash64("value"), F.lit(parts))).repartition("name", "__salt").drop("__salt").write.partitionBy("name").text(path)


def save_splits(df: DataFrame, column: str, path: str, most_lines: int) -> None:
    """Text files of at most most_lines lines."""
    df.select(F.col(column).alias("value")).write.option("maxRecordsPerFile", most_lines).text(path)


def line_index(df: DataFrame, key: str, column: str, part: str) -> DataFrame:
    """(part, key, count, offset, length): where the lines of each key stand in its sorted part."""
    sized = df.select(part, key, (F.octet_length(column) + 1).cast("long").alias("__bytes")).groupBy(part, key).agg(F.count(F.lit(1)).alias("count"), F.sum("__bytes").alias("length"))
    w = Window.partitionBy(part).orderBy(key)
    return sized.withColumn("offset", F.sum("length").over(w) - F.col("length"))


def save_csv(df: DataFrame, path: str) -> None:
    """Quoted strings with doubled quotes and their white space, a header line."""
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)
