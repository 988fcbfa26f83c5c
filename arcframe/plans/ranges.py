"""Queries over files in ranges: lines, groups over borders, budgets and attachments by path."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcframe.operators import attachments, cdx, layout, runs
from arcframe.plans.archive import _CDX
from arcframe.plans.files import _archive, _records
from arcframe.plans.relational import _FOLD
from arcframe.plans.tables import all_captures, table
from arcframe.sources import budgeted, captures, http, index_ranges, indexed, lines, text_ranges, warc


def _document_lines(spark, sf, gzip):
    path = indexed.new_folder(spark, "lines")
    lines.save_text(table(spark, sf, "documents").repartition(3), "text", path, gzip=gzip)
    found = text_ranges.load(spark, path, 20_000)
    return found.groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file", "offset", "within").alias("places"))


def text_range_lines(spark, sf):
    return _document_lines(spark, sf, False)


def text_range_lines_gzip(spark, sf):
    return _document_lines(spark, sf, True)


def _item_lines(spark, sf):
    """Lines "orderkey linenumber partkey" of all items, sorted over several files, in small ranges."""
    path = indexed.new_folder(spark, "items")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_partkey").alias("line"))
    # By line number, so that a key's lines stand in one run and runs of other keys with the same orders are apart.
    lines.save_text(layout.range_sort(items, 8, ["l_linenumber", "l_orderkey"], ["line"]), "line", path)
    return text_ranges.load(spark, path, 50_000)


def text_groups(spark, sf):
    """Runs of lines with one line number: groups that reach over ranges and files."""
    groups = runs.whole_groups(_item_lines(spark, sf), F.split("line", " ")[1])
    return groups.select("key", "rows")


def text_group_lines(spark, sf):
    found = runs.label_groups(_item_lines(spark, sf), F.split("line", " ")[1])
    return found.groupBy("group").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("rows"), F.sum(F.split("line", " ")[2].cast("long")).alias("parts")).drop("group")


def budget_load(spark, sf):
    """Partitions of customers' names by a budget of characters: what each one holds."""
    path = indexed.new_folder(spark, "names")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("line"))
    lines.save_text(layout.range_sort(rows, 5, ["c_custkey"], []), "line", path)
    loaded = budgeted.load(spark, path, 2_000, F.char_length("line"), 3_000)
    placed = loaded.select("range", F.spark_partition_id().alias("partition"), "line")
    return placed.groupBy(F.col("range").alias("bin")).agg(F.countDistinct("partition").alias("partitions"), F.count(F.lit(1)).alias("n"), F.sum(F.char_length("line")).cast("long").alias("cost"), F.min("line").alias("first"))


def file_costs(spark, sf):
    path = indexed.new_folder(spark, "costs")
    lines.save_named(table(spark, sf, "customer"), "c_mktsegment", "c_name", path, 2)
    found = budgeted.file_costs(spark, path, F.char_length("line"), 4_000)
    segment = F.regexp_extract("file", "name=([^/]+)/", 1)
    return found.groupBy(segment.alias("segment")).agg(F.sum("lines").alias("n"), F.sum("cost").cast("long").alias("cost"))


def attach_cdx(spark, sf):
    """Captures of all pages with side files by path: a line for each capture in HTML with status 200, a blank one for others."""
    path = indexed.new_folder(spark, "cdxa")
    captures.save(cdx.from_captures(all_captures(spark, sf)), path, 3)
    bare = attachments.load_cdx(spark, path, [])
    line = F.when(F.expr("status = 200 and mime = 'text/html'"), F.concat_ws(" ", "digest", F.concat(F.lit("at "), "ts14"))).otherwise("")
    attachments.save_side(bare.select("file", "line_no", line.alias("line")), "good", ".cdxa")
    found = attachments.load_cdx(spark, path, ["good"])
    available = F.col("good.status") == attachments.AVAILABLE
    return found.groupBy("surt").agg(F.count(F.lit(1)).alias("n"), F.count_if(available).alias("available"), F.min(F.when(available, F.col("good.content"))).alias("first"), F.count_if(available & (F.col("good.content") != F.concat(F.lit("at "), "ts14"))).alias("moved"))


def _index(spark, sf):
    path = indexed.new_folder(spark, "cdx-blocks")
    captures.save_indexed(cdx.from_captures(all_captures(spark, sf)), path, 40)
    return path


def _host(key):
    """The part of a key before its path; where the bracket stands, sorting by it keeps the order of keys."""
    return F.substring_index(key, ")", 1)


def cdx_range_partitions(spark, sf):
    """Lines of each host in partitions of whole hosts, and how many partitions a host is in."""
    found = index_ranges.range_partitions(spark, _index(spark, sf), 6, _host)
    return found.groupBy(_host(F.col("key")).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("partition").alias("partitions"))


def cdx_sample(spark, sf):
    """500 captures drawn from the index: their number, different places, and those that are captures."""
    drawn = index_ranges.sample(spark, _index(spark, sf), 500, 3)
    every = cdx.from_captures(all_captures(spark, sf)).select(cdx.line().alias("line")).distinct()
    found = drawn.join(every, "line", "left_semi").agg(F.count(F.lit(1)).alias("known"))
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("places")).join(F.broadcast(found))


def cogroup_files(spark, sf):
    """Orders and customers as two sorted folders, merged by key without a shuffle of lines."""
    left, right = indexed.new_folder(spark, "left"), indexed.new_folder(spark, "right")
    key = lambda c: F.lpad(F.col(c).cast("string"), 9, "0").alias("key")
    indexed.write_indexed(table(spark, sf, "orders").select(key("o_custkey"), F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("line")), left, 100)
    indexed.write_indexed(table(spark, sf, "customer").select(key("c_custkey"), F.col("c_name").alias("line")), right, 70)
    found = index_ranges.cogroup(spark, left, right, 5)
    return found.select("key", F.size("left").cast("long").alias("orders"), F.array_min("left").alias("first"), F.array_join("right", ",").alias("customer"))


def warc_budget(spark, sf):
    """Pages' records by CDX pointers, in tasks of at most 40,000 bytes: every body, and what no task exceeds."""
    rows = _records(spark, _archive(spark, sf))
    pointers = warc.to_cdx(rows).select("url", F.col("extra")[1].alias("file"), F.col("extra")[0].cast("long").alias("offset"), F.col("compressed_size").alias("length"))
    found = warc.extract_by_budget(pointers, 40_000).select("bin", F.col("row.url").alias("url"), "length", F.md5(http.parsed(F.col("payload"))["body"]).alias("body_md5"), F.spark_partition_id().alias("task"))
    w = Window.partitionBy("task")
    over = (F.sum("length").over(w) > 40_000) & (F.count(F.lit(1)).over(w) > 1)
    return found.select("url", "body_md5", over.alias("over_budget"))


QUERIES = {f.__name__: f for f in (text_range_lines, text_range_lines_gzip, text_groups, text_group_lines, budget_load, file_costs, attach_cdx, cdx_range_partitions, cdx_sample, cogroup_files, warc_budget)}

_DOCUMENT_LINES = r"""SELECT md5(regexp_replace(line, '\r$', '')) AS line_md5, count(*) AS n, count(*) AS places
    FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1"""
ORACLES = {
    "text_range_lines": _DOCUMENT_LINES,
    "text_range_lines_gzip": _DOCUMENT_LINES,
    "text_groups": "SELECT l_linenumber::VARCHAR AS key, count(*) AS rows FROM lineitem GROUP BY 1",
    "text_group_lines": "SELECT l_linenumber::VARCHAR AS key, count(*) AS rows, sum(l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1",
    "budget_load": _FOLD.format(lane="0", ord="c_custkey", cost="length(c_name || ' ' || c_mktsegment)", src="customer", budget=2_000)
    + """ SELECT bin, 1 AS partitions, count(*) AS n, sum(cost)::BIGINT AS cost, min(c_name || ' ' || c_mktsegment) AS first
          FROM b JOIN customer ON c_custkey = ord GROUP BY bin""",
    "file_costs": "SELECT c_mktsegment AS segment, count(*) AS n, sum(length(c_name))::BIGINT AS cost FROM customer GROUP BY 1",
    "attach_cdx": _CDX + """ SELECT surt, count(*) AS n, count(*) FILTER (status = 200 AND mime = 'text/html') AS available,
        min('at ' || ts14) FILTER (status = 200 AND mime = 'text/html') AS first, 0 AS moved FROM cdx GROUP BY surt""",
    "cdx_range_partitions": _CDX + " SELECT split_part(surt, ')', 1) AS host, count(*) AS n, 1 AS partitions FROM cdx GROUP BY 1",
    "cdx_sample": _CDX + " SELECT least(500, count(*)) AS n, least(500, count(*)) AS places, least(500, count(*)) AS known FROM cdx",
    "cogroup_files": """SELECT lpad(key::VARCHAR, 9, '0') AS key, count(o_orderkey) AS orders, min(o_orderkey || ' ' || o_orderstatus) AS first, coalesce(min(c_name), '') AS customer
        FROM (SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders) LEFT JOIN orders ON o_custkey = key LEFT JOIN customer ON c_custkey = key GROUP BY key""",
    "warc_budget": "SELECT url, md5(html) AS body_md5, false AS over_budget FROM pages",
}
