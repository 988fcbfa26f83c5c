"""Physical layout: budgets, uniform partitions, chunks, range and hash sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcframe.operators import budgets
from arcframe.session import stored


def budget_bins(df: DataFrame, order: str, cost: str, budget: int, lane: str | None = None, parts: int | None = None) -> DataFrame:
    """df's (order, cost, lane) with `bin`: next-fit by cost within each lane.

    Only order and cost travel. They are cut into ranges of (lane, order) and folded range by
    range (budgets), so neither a single sequence nor a long lane is one task's work. A row
    above the budget has a bin of its own; a missing cost counts 0.
    """
    lanes = F.lit(0).alias("lane") if lane is None else F.col(lane).alias("lane")
    narrow = df.select(F.col(order).alias("ord"), F.col(cost).cast("long").alias("cost"), lanes)
    width = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = in_ranges(narrow, ["lane", "ord", "cost"], width).withColumnRenamed("__part", "part")
    found = budgets.bins_of_ranges(ranged.drop("ord"), "__pos", budget, width)
    # Places within a range are those of the written table, so they name its rows.
    return ranged.select("ord", "part", "__pos").join(found, ["part", "__pos"]).select("ord", "cost", "lane", "bin")


def uniform_bins(df: DataFrame, key: str) -> DataFrame:
    """(key, rows, bin): sorted keys packed next-fit with the largest key's count as capacity."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    most = counts.agg(F.max("rows")).first()[0] or 0
    bins = budget_bins(counts, key, "rows", most)
    return bins.select(F.col("ord").alias(key), F.col("cost").alias("rows"), "bin")


def repartition_uniform(df: DataFrame, key: str) -> DataFrame:
    """df with one partition per bin of uniform_bins."""
    bins = uniform_bins(df, key).select(key, F.col("bin").cast("int").alias("__bin"))
    n = (bins.agg(F.max("__bin")).first()[0] or 0) + 1
    return df.join(bins, key).repartitionById(n, "__bin").drop("__bin")


def repartition_by_budget(df: DataFrame, order: str, cost: str, budget: int, lane: str | None = None) -> DataFrame:
    """df dealt into one partition per bin, in order."""
    bins = budget_bins(df, order, cost, budget, lane).select(F.col("ord").alias(order), "lane", "bin")
    placed = df.join(bins, order)
    return placed.repartition("lane", "bin").sortWithinPartitions(order).drop("lane", "bin")


def equal_parts(df: DataFrame, order: str, parts: int) -> DataFrame:
    """df with `part`: equal row counts, remainders spread over the first parts, no row lost.

    Rows are numbered range by range (dense_ids), so no task sees all of them.
    """
    numbered = dense_ids(df, [order], "__id")
    size, more = divmod(numbered.count(), parts)
    at, head = F.col("__id"), more * (size + 1)
    rest = F.floor((at - head) / F.lit(max(1, size))) + more
    return numbered.withColumn("part", F.when(at < head, F.floor(at / (size + 1))).otherwise(rest).cast("int")).drop("__id")


def chunks_by_rows(df: DataFrame, order: str, size: int, part: list[str]) -> DataFrame:
    """df with `chunk`: its row index within part, divided by size."""
    index = F.row_number().over(Window.partitionBy(*part).orderBy(order)) - 1
    return df.withColumn("chunk", F.floor(index / size).cast("long"))


def chunks_by_groups(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, chunk): `size` keys a chunk, in key order; keys are numbered, not rows."""
    keys = dense_ids(df.select(key).distinct(), [key], "__id")
    return keys.select(key, F.floor(F.col("__id") / size).cast("long").alias("chunk"))


def range_sort(df: DataFrame, parts: int, by: list[str], then: list[str]) -> DataFrame:
    """Ranges of `by`, each sorted by (by, then)."""
    return df.repartitionByRange(parts, *by).sortWithinPartitions(*by, *then)


def hash_sort(df: DataFrame, parts: int, by: list[str], then: list[str]) -> DataFrame:
    """Rows of one key together, each partition sorted by (by, then)."""
    return df.repartition(parts, *by).sortWithinPartitions(*by, *then)


def spread(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts)


def in_ranges(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """df cut into sorted ranges of a global order, with __part and __pos (from 0 within a part).

    Written to the shared folder, so numbers stay what they are when executors are lost.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__mono", F.monotonically_increasing_id())
    placed = ranged.withColumn("__part", F.shiftright("__mono", 33)).withColumn("__pos", F.col("__mono").bitwiseAND(F.lit((1 << 33) - 1)))
    return stored(placed.drop("__mono"), "ranges")


def dense_ids(df: DataFrame, order: list, name: str = "id", parts: int | None = None) -> DataFrame:
    """df with a gapless 0-based id in a global order.

    Ranges are sorted and numbered side by side; the ranges' starts are sums over one row a
    range. No single task sees all rows.
    """
    ranged = in_ranges(df, order, parts)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__pos")).drop("__part", "__pos", "__start")


def ids_within(df: DataFrame, lane: str, order: list, name: str) -> DataFrame:
    """df with a gapless number from 0 within each lane; no lane is one task's work."""
    ids = dense_ids(df, [lane, *order], "__id")
    first = ids.groupBy(lane).agg(F.min("__id").alias("__first"))
    return ids.join(first, lane).withColumn(name, F.col("__id") - F.col("__first")).drop("__id", "__first")


def seeded_sample(df: DataFrame, fraction: float, key: str, seed: int) -> DataFrame:
    """About fraction of the rows, the same ones for a seed however rows are dealt."""
    fraction = min(1.0, max(0.0, fraction))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int(fraction * (1 << 20)))
