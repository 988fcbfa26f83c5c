"""Sharding over fixed virtual slots.

Records are hashed into SLOTS virtual slots that never change. Bytes and rows are summed
per slot, and a versioned table maps slots to shards. Version 1 deals slots round robin;
a rebalancing edits the newest version by moving single slots and stores the result as the
next one. Only the slot table (SLOTS rows at any input size) reaches the driver.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcframe.llm.common import new_folder, written

SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def virtual_slot(id_col: str, slots: int = SLOTS):
    """The slot of an id: a function of the id alone; null ids share one."""
    return F.pmod(F.xxhash64(F.lit("slot"), F.col(id_col)), F.lit(slots)).cast("int")


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalance(owner: list[int], sizes: list[int], shards: int, most_moves: int | None = None) -> list[int]:
    """An edited copy of owner (slot -> shard) with near-equal sizes.

    The fullest shard gives the emptiest one the slot, or swaps the pair of slots, that best
    halves their gap, until no such edit narrows it. Ties go to the smallest numbers.
    """
    owner, held = list(owner), [[] for _ in range(shards)]
    load = [0] * shards
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
        load[shard] += sizes[slot]
    for _ in range(most_moves if most_moves is not None else 8 * len(owner)):
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = _best_edit([(sizes[s], s) for s in held[high]], [(sizes[s], s) for s in held[low]], gap)
        if best is None:
            break
        gain, give, take = best
        for slot, src, dst in ((give, high, low), (take, low, high)):
            if slot is not None:
                held[src].remove(slot)
                held[dst].append(slot)
                owner[slot] = dst
        load[high] -= gain
        load[low] += gain
    return owner


def _best_edit(high: list[tuple[int, int]], low: list[tuple[int, int]], gap: int):
    """(bytes moved, slot given, slot taken or None) with 0 < bytes < gap nearest to gap / 2."""
    taken = sorted([(0, -1), *low])
    keys = [size for size, _ in taken]
    best = None
    for size, slot in sorted(high):
        at = bisect_left(keys, size - gap / 2)
        for i in (at - 1, at):
            if 0 <= i < len(taken) and 0 < size - keys[i] < gap:
                off = abs(2 * (size - keys[i]) - gap)
                if best is None or (off, slot) < best[:2]:
                    best = (off, slot, size - keys[i], taken[i][1])
    return None if best is None else (best[2], best[1], None if best[3] < 0 else best[3])


def slot_totals(sized: DataFrame) -> DataFrame:
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


class SlotMap:
    """The versioned slot-to-shard table in a folder that all executors share."""

    def __init__(self, spark, path: str, slots: int = SLOTS):
        self.spark, self.path, self.slots = spark, path, slots

    def store(self, version: int, owner: list[int]) -> None:
        rows = [(version, slot, shard) for slot, shard in enumerate(owner)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{self.path}/version={version:06d}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version:06d}").select("virtual_slot", "shard")

    def owner(self, version: int) -> list[int]:
        return [r["shard"] for r in self.read(version).orderBy("virtual_slot").collect()]


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    size is the UTF-8 length of the text (null: none) plus 8. The law is `bytes`: shards get
    near-equal sums of sizes; grown_shard is null. slot counts the rows of a shard from 0
    without gaps, in the order of virtual slot, id, checksum and size; null ids sort first. An
    id's hash is its virtual slot; rows that share an id (or have none) are dealt over all
    slots by their place in the table, so that no id can fill one. An empty table gives an
    empty result.

    Texts stay where they are: only id, size and checksum are shuffled, by virtual slot.
    Rows are numbered within a virtual slot; the slots' starts are sums over SLOTS rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = written(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("__af_row"),
        ),
        "sizes",
    )
    repeats = placed.groupBy(F.col(id_col).alias("__af_id")).agg(F.count(F.lit(1)).alias("__af_copies")).where("__af_copies > 1")
    spread = F.pmod(F.xxhash64(F.col(id_col), "text_crc32", "__af_row"), F.lit(SLOTS)).cast("int")
    sized = placed.join(repeats, F.col(id_col).eqNullSafe(F.col("__af_id")), "left")
    sized = sized.withColumn("virtual_slot", F.when(F.col("__af_copies").isNull(), virtual_slot(id_col)).otherwise(spread)).drop("__af_id", "__af_copies", "__af_row")
    sized = written(sized, "slotted")
    totals = slot_totals(sized)
    sizes = [0] * SLOTS
    for row in totals.collect():
        sizes[row["virtual_slot"]] = row["bytes"]
    table = SlotMap(spark, new_folder(spark, "slot-map"))
    table.store(1, first_map(shards))
    table.store(2, rebalance(table.owner(1), sizes, shards))
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        table.read(2)
        .join(totals, "virtual_slot", "left")
        .select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("__af_start"))
    )
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size")) - 1
    return (
        sized.withColumn("__af_within", within)
        .join(F.broadcast(starts), "virtual_slot")
        .select(
            id_col,
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("__af_start") + F.col("__af_within")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.lit(2).alias("map_version"),
        )
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs below path, one folder per shard, dealt by shard and virtual slot; rows meet theirs by id, checksum and number."""
    number = lambda text: F.row_number().over(Window.partitionBy("__af_id", "__af_crc").orderBy(text))
    spots = placed.select(F.col(id_col).alias("__af_id"), F.col("text_crc32").alias("__af_crc"), "shard", "virtual_slot")
    spots = spots.withColumn("__af_n", number("virtual_slot"))
    own = docs.withColumn("__af_id", F.col(id_col)).withColumn("__af_crc", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    own = own.withColumn("__af_n", number(F.lit(0)))
    same = [own[c].eqNullSafe(spots[c]) for c in ("__af_id", "__af_crc", "__af_n")]
    joined = own.join(spots, same[0] & same[1] & same[2], "left").drop("__af_id", "__af_crc", "__af_n")
    joined.repartition("shard", "virtual_slot").write.partitionBy("shard").parquet(path)
