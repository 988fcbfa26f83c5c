"""Queries over groups, joins, sets and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcframe.operators import groups, joins, layout
from arcframe.plans.tables import table

BY_USER = (["ts", "event_id"], ["user_id"])


def run_groups(spark, sf):
    runs = groups.runs(table(spark, sf, "events"), "event_type", *BY_USER)
    return runs.groupBy("user_id", "run_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def adjacent_distinct(spark, sf):
    return groups.adjacent_distinct(table(spark, sf, "events"), "event_type", *BY_USER).select("event_id", "user_id", "event_type")


def first_of_sorted(spark, sf):
    return groups.first_per_key(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


def zip_next(spark, sf):
    return groups.zip_next(table(spark, sf, "events").select("event_id", "user_id", "ts"), "event_id", ["ts", "event_id"], ["user_id"]).drop("ts")


def zip_index(spark, sf):
    return groups.zip_index(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], ["user_id"]).drop("ts")


def take_until(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return groups.take_until(events, F.col("event_type") == "purchase", *BY_USER).drop("ts")


def drop_until(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return groups.drop_until(events, F.col("event_type") == "purchase", *BY_USER).drop("ts")


def reduce_by_key(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("last_order"))


def distinct_minus(spark, sf):
    return groups.distinct_minus(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")))


def combine_maps(spark, sf):
    of = lambda status: F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderpriority", "n")))).alias(status)
    counts = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    left = counts.where("o_orderstatus = 'F'").agg(of("f"))
    others = counts.where("not o_orderstatus <=> 'F'").groupBy("o_orderpriority").agg(F.sum("n").alias("n"))
    right = others.agg(of("o"))
    both = left.join(F.broadcast(right)).select(groups.combine_maps(F.col("f"), F.col("o")).alias("m"))
    return both.select(F.explode("m").alias("priority", "n"))


def topk_map(spark, sf):
    return groups.top_keys(table(spark, sf, "lineitem"), "l_partkey", F.sum("l_quantity").cast("long"), 25)


def group_total(spark, sf):
    suppliers = table(spark, sf, "supplier").withColumn("cents", F.round(F.col("s_acctbal") * 100).cast("long"))
    return groups.group_total(suppliers.select("s_suppkey", "s_nationkey", "cents"), "s_nationkey", "cents", "nation_cents")


def cogroup_orders_lineitem(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    both = joins.cogroup({"customers": (orders, "o_orderkey", F.col("o_custkey")), "parts": (lines, "l_orderkey", F.col("l_partkey"))})
    return both.select("key", F.array_join("customers", ",").alias("customers"), F.array_join("parts", ",").alias("parts"))


def exists_flag(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 300000")
    return joins.exists_flag(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey")


def lookup_left(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    found = joins.lookup(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderkey"), "orders")
    return found.select("c_custkey", F.array_join("orders", ",").alias("orders"))


def subtract_keys(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joins.subtract_keys(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


def subtract_values(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return joins.subtract_values(lines, lines.where("l_returnflag = 'R'"), "l_suppkey", "l_partkey")


def merge_sorted(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("c").alias("kind")).unionAll(table(spark, sf, "supplier").select("s_name", F.lit("s")))
    return names.orderBy("name", "kind")


def _prefixes(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.array(F.substring("p_type", 1, 5), F.substring("p_type", 1, 8), F.substring_index("p_type", " ", 2))).alias("prefix")).where("prefix not like 'STANDARD%'").distinct()


def prefix_match(spark, sf):
    return joins.prefix_match(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", _prefixes(spark, sf), "prefix")


def prefix_shortest(spark, sf):
    return joins.prefix_match(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", _prefixes(spark, sf), "prefix", shortest_wins=True)


def prefix_filter(spark, sf):
    prefixes = spark.createDataFrame([("http://www.",), ("https://",)], "prefix string")
    return joins.prefix_match(table(spark, sf, "pages").select("page_id", "url"), "url", prefixes, "prefix", inner=True).select("page_id", "url", "matched")


def key_from(spark, sf):
    return joins.key_from(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "m")


def key_before(spark, sf):
    return joins.key_before(table(spark, sf, "pages").select("page_id", "url"), "url", "http://t")


def drop_keys(spark, sf):
    return joins.drop_keys(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 5)


def adjacent_asof(spark, sf):
    return joins.adjacent(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf, "customer"), "c_custkey")


def index_candidates(spark, sf):
    index = table(spark, sf, "pages").select((F.col("page_id") % 2).alias("file"), F.col("url").alias("key"))
    prefixes = spark.createDataFrame([("http://www.",), ("https://t",), ("http://t",)], "prefix string")
    return joins.index_candidates(index, "key", "file", prefixes, "prefix")


def pointer_islands(spark, sf):
    pointers = table(spark, sf, "events").select((F.col("user_id") % 8).alias("file"), (F.col("event_id") * 100).alias("offset"), (20 + F.col("event_id") % 90).alias("length"))
    return joins.islands(pointers, "file", "offset", "length", 500)


def budget_bins(spark, sf):
    return layout.budget_bins(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50_000).select(F.col("ord").alias("doc_id"), "bin")


def budget_lanes(spark, sf):
    bins = layout.budget_bins(table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "doc_id", "n_chars", 9_000, "source")
    return bins.groupBy("lane", "bin").agg(F.sum("cost").alias("chars"), F.count(F.lit(1)).alias("n"))


def uniform_partitions(spark, sf):
    return layout.uniform_bins(table(spark, sf, "customer"), "c_nationkey")


def equal_partitions(spark, sf):
    return layout.equal_parts(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


def chunks_by_lines(spark, sf):
    return layout.chunks_by_rows(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 64, ["event_type"])


def chunks_by_groups(spark, sf):
    return layout.chunks_by_groups(table(spark, sf, "lineitem"), "l_suppkey", 8)


def sort_range_within(spark, sf):
    rows = layout.range_sort(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 8, ["l_orderkey"], ["l_linenumber"])
    return rows.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("low"), F.max("l_linenumber").alias("high"))


def hash_sort_within(spark, sf):
    rows = layout.hash_sort(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), 8, ["l_suppkey"], ["l_partkey"])
    return rows.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


def dense_ids(spark, sf):
    return layout.dense_ids(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), [F.desc("c_mktsegment"), F.asc("c_custkey")])


def rows_sample(spark, sf):
    return layout.seeded_sample(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), 0.1, "l_orderkey", 7)


def repartitioned_uniform(spark, sf):
    rows = layout.repartition_uniform(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")
    return rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


def distinct_minus_whole(spark, sf):
    return groups.distinct_minus(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"))


QUERIES = {f.__name__: f for f in (run_groups, adjacent_distinct, first_of_sorted, zip_next, zip_index, take_until, drop_until, reduce_by_key, distinct_minus, combine_maps, topk_map, group_total, cogroup_orders_lineitem, exists_flag, lookup_left, subtract_keys, subtract_values, merge_sorted, prefix_match, prefix_shortest, prefix_filter, key_from, key_before, drop_keys, adjacent_asof, index_candidates, pointer_islands, budget_bins, budget_lanes, uniform_partitions, equal_partitions, chunks_by_lines, chunks_by_groups, sort_range_within, hash_sort_within, dense_ids, rows_sample, repartitioned_uniform, distinct_minus_whole)}
#: Second names of queries, from when only these read whole tables.
WHOLE = {f"{f.__name__}_whole": f for f in (cogroup_orders_lineitem, adjacent_asof, index_candidates)}
QUERIES |= WHOLE

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_PREFIXES = """p AS (SELECT DISTINCT prefix FROM (SELECT unnest([left(p_type, 5), left(p_type, 8), array_to_string(string_split(p_type, ' ')[1:2], ' ')]) AS prefix FROM part)
             WHERE prefix NOT LIKE 'STANDARD%')"""
_FOLD = """WITH RECURSIVE d AS (SELECT {lane} AS lane, {ord} AS ord, {cost}::BIGINT AS cost, row_number() OVER (PARTITION BY {lane} ORDER BY {ord}) AS i FROM {src}),
    b AS (SELECT lane, ord, cost, i, 0::BIGINT AS bin, cost AS held FROM d WHERE i = 1 UNION ALL
          SELECT d.lane, d.ord, d.cost, d.i, CASE WHEN b.held > 0 AND b.held + d.cost > {budget} THEN b.bin + 1 ELSE b.bin END,
                 CASE WHEN b.held > 0 AND b.held + d.cost > {budget} THEN d.cost ELSE b.held + d.cost END
          FROM b JOIN d ON d.lane = b.lane AND d.i = b.i + 1)"""
ORACLES = {
    "run_groups": f"""
        WITH f AS (SELECT *, CASE WHEN lag(event_type) {_W}) = event_type THEN 0 ELSE 1 END AS fresh FROM events),
             r AS (SELECT *, sum(fresh) {_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM f)
        SELECT user_id, run_id, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run_id, event_type""",
    "adjacent_distinct": f"SELECT event_id, user_id, event_type FROM events QUALIFY coalesce(lag(event_type) {_W}) <> event_type, true)",
    "first_of_sorted": "SELECT user_id, event_type, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "zip_next": f"SELECT event_id, user_id, lead(event_id) {_W}) AS next_event_id FROM events",
    "zip_index": f"SELECT event_id, user_id, row_number() {_W}) - 1 AS index FROM events",
    "take_until": f"SELECT event_id, user_id, event_type FROM events QUALIFY coalesce(sum((event_type = 'purchase')::INT) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0",
    "drop_until": f"SELECT event_id, user_id, event_type FROM events QUALIFY sum((event_type = 'purchase')::INT) {_W} ROWS UNBOUNDED PRECEDING) > 0",
    "reduce_by_key": "SELECT l_suppkey, sum(l_quantity)::BIGINT AS quantity, count(*) AS n, max(l_orderkey) AS last_order FROM lineitem GROUP BY l_suppkey",
    "distinct_minus": "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "combine_maps": "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "topk_map": "SELECT l_partkey, sum(l_quantity)::BIGINT AS value FROM lineitem GROUP BY l_partkey ORDER BY value DESC, l_partkey LIMIT 25",
    "group_total": "SELECT s_suppkey, s_nationkey, round(s_acctbal * 100)::BIGINT AS cents, (sum(round(s_acctbal * 100)::BIGINT) OVER (PARTITION BY s_nationkey))::BIGINT AS nation_cents FROM supplier",
    "cogroup_orders_lineitem": """
        WITH o AS (SELECT o_orderkey AS key, string_agg(o_custkey, ',' ORDER BY o_custkey) AS customers FROM orders GROUP BY 1),
             l AS (SELECT l_orderkey AS key, string_agg(l_partkey, ',' ORDER BY l_partkey) AS parts FROM lineitem GROUP BY 1)
        SELECT key, coalesce(customers, '') AS customers, coalesce(parts, '') AS parts FROM o FULL JOIN l USING (key)""",
    "exists_flag": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS found FROM customer",
    "lookup_left": "SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "subtract_keys": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "subtract_values": "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "merge_sorted": "SELECT c_name AS name, 'c' AS kind FROM customer UNION ALL SELECT s_name, 's' FROM supplier ORDER BY name, kind",
    "prefix_match": f"WITH {_PREFIXES} SELECT p_partkey, p_type, max_by(prefix, length(prefix)) AS matched FROM part LEFT JOIN p ON starts_with(p_type, prefix) GROUP BY ALL",
    "prefix_shortest": f"WITH {_PREFIXES} SELECT p_partkey, p_type, min_by(prefix, length(prefix)) AS matched FROM part LEFT JOIN p ON starts_with(p_type, prefix) GROUP BY ALL",
    "prefix_filter": "SELECT page_id, url, p AS matched FROM pages JOIN (VALUES ('http://www.'), ('https://')) t(p) ON starts_with(url, p)",
    "key_from": "SELECT p_partkey, p_name FROM part WHERE p_name >= 'm'",
    "key_before": "SELECT page_id, url FROM pages WHERE url >= 'http://t' OR url = (SELECT max(url) FROM pages WHERE url < 'http://t')",
    "drop_keys": "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5)",
    "adjacent_asof": """
        WITH o AS (SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders)
        SELECT o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey >= o_orderkey AND (nxt IS NULL OR c_custkey < nxt))""",
    "index_candidates": """
        WITH i AS (SELECT page_id % 2 AS file, url AS key, lead(url) OVER (PARTITION BY page_id % 2 ORDER BY url) AS nxt FROM pages)
        SELECT file, key, p AS prefix FROM i JOIN (VALUES ('http://www.'), ('https://t'), ('http://t')) t(p)
        ON (key <= p OR starts_with(key, p)) AND (nxt IS NULL OR nxt >= p)""",
    "pointer_islands": """
        WITH q AS (SELECT user_id % 8 AS file, event_id * 100 AS off, 20 + event_id % 90 AS len FROM events),
             m AS (SELECT *, CASE WHEN off - max(off + len) OVER (PARTITION BY file ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 500 THEN 0 ELSE 1 END AS fresh FROM q),
             s AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY off, len ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m)
        SELECT file, island, min(off) AS begin, max(off + len) - min(off) AS bytes, count(*) AS pointers FROM s GROUP BY file, island""",
    "budget_bins": _FOLD.format(lane="0", ord="doc_id", cost="n_chars", src="documents", budget=50_000) + " SELECT ord AS doc_id, bin FROM b",
    "budget_lanes": _FOLD.format(lane="source", ord="doc_id", cost="n_chars", src="documents", budget=9_000) + " SELECT lane, bin, sum(cost)::BIGINT AS chars, count(*) AS n FROM b GROUP BY lane, bin",
    "uniform_partitions": _FOLD.format(lane="0", ord="c_nationkey", cost="n", src="(SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)", budget="(SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey))") + " SELECT ord AS c_nationkey, cost AS rows, bin FROM b",
    "equal_partitions": "SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS part FROM orders",
    "chunks_by_lines": "SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 64 AS chunk FROM events",
    "chunks_by_groups": "SELECT l_suppkey, (row_number() OVER (ORDER BY l_suppkey) - 1) // 8 AS chunk FROM (SELECT DISTINCT l_suppkey FROM lineitem)",
    "sort_range_within": "SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY l_orderkey",
    "hash_sort_within": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey",
    "dense_ids": "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) - 1 AS id FROM customer",
    "repartitioned_uniform": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "distinct_minus_whole": "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
}
ORACLES |= {name: ORACLES[f.__name__] for name, f in WHOLE.items()}
