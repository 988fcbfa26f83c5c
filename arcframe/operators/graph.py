"""Link graph: links, nodes with dense ids, adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcframe.functions import surt
from arcframe.operators.groups import first_per_key
from arcframe.operators.layout import dense_ids


def links(anchors: DataFrame) -> DataFrame:
    """(src_surt, src_url, ts14, dst_surt, dst_url) of (src_url, ts14, dst_url).

    Targets need a valid host; the shortest, then smallest, URL stands for a target's key.
    """
    # The explode of one row keeps the optimiser from writing the long key expressions out again in filter and keys.
    keys = F.struct(surt.surt(F.col("src_url")).alias("src_surt"), surt.surt(F.col("dst_url")).alias("dst_surt"))
    keyed = anchors.select("src_url", "ts14", "dst_url", F.explode(F.array(keys)).alias("k")).select("src_url", "k.src_surt", "ts14", "dst_url", "k.dst_surt")
    valid = keyed.where(surt.is_valid_host(surt.surt_host(F.col("dst_surt"))))
    return first_per_key(valid, ["src_surt", "src_url", "ts14", "dst_surt"], [F.char_length("dst_url"), F.col("dst_url")])


def nodes(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(surt, url, host, count, id): ids by descending host total, host, count, key.

    sources (src_surt, src_url) are kept even without links.
    """
    every = edges.select(F.col("dst_surt").alias("surt"), F.col("dst_url").alias("url")).unionByName(sources.select(F.col("src_surt").alias("surt"), F.col("src_url").alias("url")))
    counted = every.groupBy("surt").agg(F.count(F.lit(1)).alias("count"), F.min_by("url", F.struct(F.char_length("url"), "url")).alias("url"))
    counted = counted.withColumn("host", surt.surt_host(F.col("surt"))).where(surt.is_valid_host(F.col("host")))
    totals = counted.groupBy("host").agg(F.sum("count").alias("host_count"))
    placed = counted.join(totals, "host")
    order = [F.desc("host_count"), F.asc("host"), F.desc("count"), F.asc("surt")]
    return dense_ids(placed, order).select("surt", "url", "host", "count", "id")


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_id, ts14, dst_ids) with sorted distinct targets; pages without links have no row."""
    ids = nodes.select("surt", "id")
    by_source = edges.join(ids.select(F.col("surt").alias("src_surt"), F.col("id").alias("src_id")), "src_surt")
    both = by_source.join(ids.select(F.col("surt").alias("dst_surt"), F.col("id").alias("dst_id")), "dst_surt")
    return both.groupBy("src_id", "ts14").agg(F.sort_array(F.collect_set("dst_id")).alias("dst_ids"))


def node_json() -> Column:
    return F.to_json(F.struct(F.col("surt").alias("surt_url"), "url", "id"))


def adjacency_json() -> Column:
    return F.to_json(F.struct(F.col("src_id").alias("id"), F.col("ts14").alias("timestamp"), F.col("dst_ids").alias("outlink_ids")))


def parse_nodes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows of node JSON; lines that lack a field go."""
    parsed = lines.select(F.from_json(column, "surt_url string, url string, id long").alias("n")).select("n.*")
    return parsed.dropna().select(F.col("surt_url").alias("surt"), "url", "id")
