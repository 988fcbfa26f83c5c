"""Text read by a budget of costs: what lines cost decides how files are cut and packed into partitions.

Costs are summed per file or line where the lines are read; a cost that fails (null) is 0.
Lines of plain files are packed next-fit over the files in their order, so a partition stays
within the budget unless a single line exceeds it. A gzip file is one unit, whatever it costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcframe.operators import budgets
from arcframe.session import stored
from arcframe.sources import indexed, lines, text_ranges

#: Bytes of neighbouring ranges that a task folds at once, and the bits that a place in a file may have.
PART_BYTES, OFFSET_BITS = 4 << 20, 43
#: Bins of fewer bytes at the mean are small.
SMALL_BIN = 256 << 10


def _costed(spark: SparkSession, path: str, cost: Column, split_bytes: int) -> DataFrame:
    found = text_ranges.load(spark, path, split_bytes)
    return found.select("file", "range", "offset", F.greatest(F.lit(0), F.coalesce(cost, F.lit(0))).cast("long").alias("cost"))


def file_costs(spark: SparkSession, path: str, cost: Column, split_bytes: int = text_ranges.SPLIT_BYTES) -> DataFrame:
    """(file, lines, cost) of text files; cost is an expression over `line`."""
    return _costed(spark, path, cost, split_bytes).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum("cost").alias("cost"))


def partition_costs(df: DataFrame, cost: Column) -> DataFrame:
    """(partition, rows, cost) of the partitions that df has."""
    placed = df.select(F.spark_partition_id().alias("partition"), F.coalesce(cost, F.lit(0)).alias("cost"))
    return placed.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.sum("cost").cast("long").alias("cost"))


def write_plan(spark: SparkSession, path: str, budget: int, cost: Column, split_bytes: int = text_ranges.SPLIT_BYTES) -> str:
    """The folder of a plan (bin, part, file, begin, end) that text_ranges reads by."""
    rows = _costed(spark, path, cost, split_bytes)
    packed = F.col("file").endswith(".gz")
    whole = rows.where(packed).groupBy("file").agg(F.min("range").alias("range"), F.lit(0).cast("long").alias("offset"), F.sum("cost").alias("cost"))
    # Neighbouring small ranges are folded as one part; a line's place there is its range's number within the part, then its offset.
    several = max(1, min(PART_BYTES // split_bytes, 1 << (62 - OFFSET_BITS)))
    place = F.shiftleft(F.col("range") % several, OFFSET_BITS) + F.col("offset")
    units = stored(rows.where(~packed).unionByName(whole), "units")
    parts = units.select(F.lit(0).alias("lane"), F.floor(F.col("range") / several).cast("long").alias("part"), place.alias("place"), "cost")
    width = (parts.agg(F.max("part")).first()[0] or 0) + 1
    names = units.select("range", "file").distinct()
    bins = budgets.bins_of_ranges(parts, "place", budget, width)
    bins = bins.select("bin", (F.col("part") * several + F.shiftright("place", OFFSET_BITS)).alias("range"), F.col("place").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1)).alias("offset"))
    spans = bins.groupBy("bin", "range").agg(F.min("offset").alias("begin"), F.max("offset").alias("end")).join(names, "range")
    plan = spans.groupBy("bin", "file").agg(F.min("range").alias("part"), F.min("begin").alias("begin"), (F.max("end") + 1).alias("end"))
    folder = indexed.new_folder(spark, "plan")
    plan.select("bin", "part", "file", "begin", "end").write.parquet(folder)
    return folder


def load(spark: SparkSession, path: str, budget: int, cost: Column, split_bytes: int = text_ranges.SPLIT_BYTES) -> DataFrame:
    """Lines (file, offset, within, line, range) in one partition a bin; range is the bin.

    A bin is read by a task of its own. Where they are many and small, tasks that read many of
    them deal their lines to the bins' partitions, as a task in Python costs more than its bin.
    """
    plan = write_plan(spark, path, budget, cost, split_bytes)
    reader = spark.read.format("text_ranges").option("plan", plan)
    tasks = 4 * spark.sparkContext.defaultParallelism
    sizes = spark.read.parquet(plan).agg(F.max("bin").alias("last"), F.sum(F.col("end") - F.col("begin")).alias("bytes"), F.bool_or(F.col("file").endswith(".gz")).alias("packed")).first()
    bins = 0 if sizes["last"] is None else int(sizes["last"]) + 1
    if bins <= tasks or sizes["packed"] or sizes["bytes"] >= bins * SMALL_BIN:
        return reader.load()
    dealt = reader.option("tasks", str(tasks)).load().repartitionById(bins, F.col("range").cast("int"))
    return dealt.sortWithinPartitions("file", "offset", "within")


def reload(df: DataFrame, column: str, budget: int, cost: Column) -> DataFrame:
    """The strings of a column, written as text once and read again by budget."""
    folder = indexed.new_folder(df.sparkSession, "reload")
    lines.save_text(df, column, folder)
    return load(df.sparkSession, folder, budget, cost)
