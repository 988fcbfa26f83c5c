"""Grouping, distinct and window-like operators over explicit orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: str, order: list[str], part: list[str]) -> DataFrame:
    """df with run_id: adjacent rows with equal keys (in `order`, within `part`) share one.

    Equal keys that are not adjacent get different runs.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    fresh = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__fresh", fresh).withColumn("run_id", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def adjacent_distinct(df: DataFrame, key: str, order: list[str], part: list[str]) -> DataFrame:
    """The first row of each run."""
    w = Window.partitionBy(*part).orderBy(*order)
    same = F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1)
    return df.withColumn("__same", same).where("not __same").drop("__same")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; a bounded aggregate, no window sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.row.*")


def zip_next(df: DataFrame, value: str, order: list[str], part: list[str]) -> DataFrame:
    return df.withColumn(f"next_{value}", F.lead(value).over(Window.partitionBy(*part).orderBy(*order)))


def zip_index(df: DataFrame, order: list[str], part: list[str]) -> DataFrame:
    """df with a 0-based index within part."""
    return df.withColumn("index", (F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1).cast("long"))


def take_until(df: DataFrame, stop: Column, order: list[str], part: list[str], including: bool = True) -> DataFrame:
    """Rows up to the first where stop holds."""
    w = Window.partitionBy(*part).orderBy(*order)
    seen = F.sum(F.when(stop, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1 if including else 0))
    return df.withColumn("__seen", F.coalesce(seen, F.lit(0))).where("__seen = 0").drop("__seen")


def drop_until(df: DataFrame, start: Column, order: list[str], part: list[str]) -> DataFrame:
    """Rows from the first where start holds."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__seen", F.sum(F.when(start, 1).otherwise(0)).over(w)).where("__seen > 0").drop("__seen")


def distinct_minus(df: DataFrame, minus: DataFrame) -> DataFrame:
    return df.distinct().subtract(minus)


def combine_maps(left: Column, right: Column) -> Column:
    """Map of both keys' sums."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def top_keys(df: DataFrame, key: str, value: Column, n: int) -> DataFrame:
    """The n keys with the largest sums; ties by key."""
    return df.groupBy(key).agg(value.alias("value")).orderBy(F.desc("value"), F.asc(key)).limit(n)


def group_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Every row with the sum of its group."""
    return df.join(df.groupBy(key).agg(F.sum(value).alias(name)), key)
