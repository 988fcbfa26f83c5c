"""Cogroups, lookups, prefix joins and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcframe.operators.layout import in_ranges

#: Prefixes are broadcast up to this number; beyond it they are joined by key.
BROADCAST_PREFIXES = 100_000


def cogroup(inputs: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """Full outer cogroup: key and one sorted array per input, empty where it has no row.

    inputs: name -> (frame, key column, value). All inputs are tagged and meet in one
    grouping, so a key is shuffled once however many inputs there are.
    """
    names = list(inputs)
    parts = [
        df.select(F.col(key).alias("key"), *[(value if other == name else F.lit(None)).alias(f"v_{other}") for other in names], F.lit(i).alias("src"))
        for i, (name, (df, key, value)) in enumerate(inputs.items())
    ]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy("key").agg(*[F.sort_array(F.collect_list(F.when(F.col("src") == i, F.col(f"v_{name}")))).alias(name) for i, name in enumerate(names)])


def exists_flag(df: DataFrame, keys: DataFrame, column: str, key: str, flag: str = "found") -> DataFrame:
    """df with whether its column is among keys."""
    known = keys.select(F.col(key).alias("__key")).distinct().withColumn("__in", F.lit(True))
    return df.join(known, df[column] == F.col("__key"), "left").withColumn(flag, F.coalesce("__in", F.lit(False))).drop("__key", "__in")


def lookup(left: DataFrame, right: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Left rows with the sorted array of their matches; every left row gets all of them."""
    found = right.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))
    return left.join(found, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))


def subtract_keys(df: DataFrame, minus: DataFrame, key: str) -> DataFrame:
    return df.join(minus.select(key).distinct(), key, "left_anti")


def subtract_values(df: DataFrame, minus: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value) rows of df that minus does not have."""
    return df.select(key, value).distinct().join(minus.select(key, value), [key, value], "left_anti")


def key_from(df: DataFrame, key: str, low: str) -> DataFrame:
    return df.where(F.col(key) >= low)


def key_before(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows from the last key below `at` on: that key, and all from `at`."""
    last = df.where(F.col(key) < at).agg(F.max(key).alias("__last"))
    return df.join(F.broadcast(last)).where((F.col(key) >= at) | (F.col(key) == F.col("__last"))).drop("__last")


def drop_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows without the n smallest keys."""
    first = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(F.broadcast(first), key, "left_anti")


def prefix_hits(values: DataFrame, column: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(column, __p): every prefix of each value, the empty one included; values are distinct.

    Values are cut to every length that occurs among prefixes, and the cuts are joined by
    equality. No pair of a value and a prefix that differ is ever made.
    """
    known = prefixes.select(F.col(prefix).alias("__p")).where("__p is not null").distinct()
    lengths = F.broadcast(known.agg(F.sort_array(F.collect_set(F.char_length("__p"))).alias("__lengths")))
    fitting = F.filter("__lengths", lambda n: n <= F.char_length(F.col(column)))
    cuts = values.join(lengths).select(column, F.explode(F.transform(fitting, lambda n: F.substring(F.col(column), F.lit(1), n))).alias("__p"))
    side = F.broadcast(known) if known.count() <= BROADCAST_PREFIXES else known
    return cuts.join(side, "__p")


def prefix_match(df: DataFrame, column: str, prefixes: DataFrame, prefix: str, shortest_wins: bool = False, inner: bool = False) -> DataFrame:
    """df with `matched`: the longest (or shortest) of prefixes that starts the column, else null.

    Distinct values are matched and joined back by value. inner leaves out rows without one.
    """
    hits = prefix_hits(df.select(column).distinct(), column, prefixes, prefix)
    pick = F.min_by if shortest_wins else F.max_by
    best = hits.groupBy(column).agg(pick("__p", F.char_length("__p")).alias("matched"))
    return df.join(best, column, "inner" if inner else "left")


def adjacent(df: DataFrame, key: str, lookups: DataFrame, lookup_key: str) -> DataFrame:
    """Rows with a lookup value in [key, next key): an as-of semi join.

    Both sides meet in one order that is cut into ranges; the last key at or before each
    lookup value is kept, and the last key of a range is carried into the next ones.
    """
    both = df.select(F.col(key).alias("k"), F.lit(0).alias("side")).unionByName(lookups.select(F.col(lookup_key).alias("k"), F.lit(1).alias("side"))).where("k is not null")
    ranged = in_ranges(both.distinct(), ["k", "side"])
    own = F.when(F.col("side") == 0, F.col("k"))
    ends = ranged.groupBy("__part").agg(F.max(own).alias("__end"))
    carried = ends.select("__part", F.max("__end").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    within = F.max(own).over(Window.partitionBy("__part").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, 0))
    hit = ranged.join(F.broadcast(carried), "__part").withColumn("hit", F.coalesce(within, "__carried"))
    hit = hit.where("side = 1 and hit is not null").select(F.col("hit").alias("__hit")).distinct()
    return df.join(hit, df[key] == F.col("__hit"), "left_semi")


def following(df: DataFrame, lookups: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """lookups with the columns take of the first row of df that has their keys and stands at or behind `at`.

    Both sides meet in one order that is cut into ranges; the first row of a range is carried
    back into those before it. No key is one task's work. Nulls where there is no such row;
    of rows of df at one place any counts.
    """
    others = [c for c in lookups.columns if c not in (*keys, at)]
    own, row = F.struct(F.lit(True).alias("__is"), *others), F.struct(F.lit(True).alias("__is"), *take)
    left = lookups.select(*keys, at, F.lit(0).alias("__side"), own.alias("__own"))
    right = df.select(*keys, at, F.lit(1).alias("__side"), row.alias("__row"))
    ranged = in_ranges(left.unionByName(right, allowMissingColumns=True), [*keys, at, "__side"])
    found = F.when(F.col("__side") == 1, F.struct(*keys, "__row"))
    heads = ranged.where("__side = 1").groupBy("__part").agg(F.min_by(F.struct(*keys, "__row"), "__pos").alias("__head"))
    parts = ranged.select("__part").distinct().join(heads, "__part", "left")
    behind = F.last("__head", ignorenulls=True).over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1))
    within = F.last(found, ignorenulls=True).over(Window.partitionBy("__part").orderBy(F.desc("__pos")).rowsBetween(Window.unboundedPreceding, 0))
    hit = ranged.withColumn("__within", within).where("__side = 0").join(F.broadcast(parts.select("__part", behind.alias("__behind"))), "__part")
    hit = hit.withColumn("__hit", F.coalesce("__within", "__behind"))
    same = reduce(lambda a, b: a & b, (F.col(f"__hit.{k}").eqNullSafe(F.col(k)) for k in keys))
    return hit.select(*keys, at, *[F.col(f"__own.{c}").alias(c) for c in others], *[F.when(same, F.col(f"__hit.__row.{c}")).alias(c) for c in take])


def index_candidates(index: DataFrame, key: str, part: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """(part, key, prefix) of the index lines whose block can hold a key that begins with prefix.

    A block reaches from its key up to, and including, the next line's key within its part.
    Blocks that begin within a prefix are met by prefix_match; in each part one more block
    begins before the prefix and reaches it, which is looked up in the order of the blocks' ends.
    """
    w = Window.partitionBy("__p").orderBy("__k")
    spans = index.select(F.col(part).alias("__p"), F.col(key).alias("__k")).withColumn("__next", F.lead("__k").over(w))
    known = prefixes.select(F.col(prefix).alias("__x")).where("__x is not null").distinct()
    within = _all_prefixes(spans.select("__p", "__k"), "__k", known, "__x")
    ends = spans.groupBy("__p", F.coalesce("__next", F.lit("\U0010ffff" * 4)).alias("__at")).agg(F.min("__k").alias("__begin"))
    parts = spans.agg(F.collect_set("__p").alias("__parts"))
    asked = known.join(F.broadcast(parts)).select(F.explode("__parts").alias("__p"), F.col("__x").alias("__at"))
    before = following(ends, asked, ["__p"], "__at", ["__begin"]).where("__begin < __at")
    found = within.select("__p", "__k", "__x").unionByName(before.select("__p", F.col("__begin").alias("__k"), F.col("__at").alias("__x")))
    return found.select(F.col("__p").alias(part), F.col("__k").alias(key), F.col("__x").alias(prefix))


def _all_prefixes(df: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """df joined with every one of the distinct prefixes that its key begins with: keys are cut to the lengths that occur."""
    lengths = [r[0] for r in prefixes.select(F.char_length(prefix)).distinct().collect()]
    cut = df.withColumn("__n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where(F.col("__n") <= F.char_length(key))
    return cut.withColumn(prefix, F.expr(f"substring(`{key}`, 1, __n)")).drop("__n").join(prefixes, prefix)


def islands(pointers: DataFrame, part: str, offset: str, length: str, tolerance: int) -> DataFrame:
    """Pointers coalesced where the gap to the furthest end before is at most tolerance."""
    w = Window.partitionBy(part).orderBy(offset, length)
    end = F.max(F.col(offset) + F.col(length)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = pointers.withColumn("__new", F.when(F.col(offset) - end <= tolerance, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.col(offset) + F.col(length))
    return marked.groupBy(part, "island").agg(F.min(offset).alias("begin"), (last - F.min(offset)).alias("bytes"), F.count(F.lit(1)).alias("pointers"))
