"""Queries over saved files: names, splits, groups of files, jobs over splits, charsets and piped attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcframe.functions import charsets
from arcframe.operators import attachments, layout
from arcframe.plans.relational import _FOLD
from arcframe.plans.tables import table
from arcframe.sources import file_groups, indexed, lines, routed, text_ranges
from arcframe.sources.ranges import Ranged


def charset_pages(spark, sf):
    """Pages in two charsets, each declared in its first line, read without being told."""
    even = F.col("page_id") % 2 == 0
    body = F.when(even, F.encode(F.concat(F.lit('<meta charset="iso-8859-1">\n'), "html"), "ISO-8859-1"))
    body = body.otherwise(F.encode(F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), "html"), "UTF-8"))
    pages = table(spark, sf, "pages").select("page_id", body.alias("body"))
    return pages.select("page_id", F.md5(charsets.adaptive(F.col("body"))).alias("text_md5"))


def named_binary_files(spark, sf):
    """Texts appended to the file of their source and language: what each file holds."""
    path = indexed.new_folder(spark, "named")
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("name"), F.encode("text", "UTF-8").alias("body"))
    routed.save_named_files(docs, "name", "body", path, ["doc_id"])
    files = lines.read_binary(spark, f"{path}/*/*")
    return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.md5("content").alias("body_md5"))


def named_file_parts(spark, sf):
    """Texts by source, packed: files of at most 30,000 bytes, numbered within a source."""
    path = indexed.new_folder(spark, "named-parts")
    routed.save_named_files(table(spark, sf, "documents"), "source", "text", path, ["doc_id"], 30_000, packed=True)
    files = lines.read_binary(spark, path, unpack=True)
    name = F.regexp_extract("path", r"([^/]+)-\d+\.gz$", 1)
    return files.select(name.alias("source"), F.regexp_extract("path", r"-(\d+)\.gz$", 1).cast("long").alias("bin"), F.md5("content").alias("body_md5"))


def _lines_of(files):
    return files.select(F.regexp_extract("path", r"-(\d+)\.txt$", 1).cast("long").alias("bin"), F.md5("content").alias("body_md5"))


def text_splits_by_bytes(spark, sf):
    path = indexed.new_folder(spark, "byte-splits")
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\n", " ").alias("line"))
    routed.save_splits(docs, "line", path, ["doc_id"], 100_000)
    return _lines_of(lines.read_binary(spark, f"{path}/split-*"))


def text_splits_by_groups(spark, sf):
    """Orders as files of at most 500 lines, no customer in two of them."""
    path = indexed.new_folder(spark, "group-splits")
    routed.save_splits(table(spark, sf, "orders"), "o_orderkey", path, ["o_orderkey"], 500, "lines", "o_custkey")
    return _lines_of(lines.read_binary(spark, f"{path}/split-*"))


def text_parts(spark, sf):
    """Names saved once; the second call finds the folder complete and writes nothing."""
    path = indexed.new_folder(spark, "parts")
    names = layout.range_sort(table(spark, sf, "customer").select("c_custkey", "c_name"), 4, ["c_custkey"], [])
    first = routed.save_parts(names, "c_name", path, packed=True, skip_if_exists=True)
    again = routed.save_parts(names, "c_name", path, packed=True, skip_if_exists=True)
    found = text_ranges.load(spark, path)
    return found.select(F.col("line").alias("c_name"), F.lit(first).cast("long").alias("first"), F.lit(again).cast("long").alias("again"))


def _segments(spark, sf):
    """Customers' names in two files a market segment, by the parity of their key."""
    path = indexed.new_folder(spark, "segments")
    name = F.concat(F.col("c_mktsegment"), F.lit("-"), F.col("c_custkey") % 2, F.lit(".txt"))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("name"), F.concat("c_name", F.lit("\n")).alias("line"))
    routed.save_named_files(rows, "name", "line", path, ["c_custkey"])
    return path


_SEGMENT = r"([^/]+)-\d\.txt$"


def file_group_lines(spark, sf):
    """The files of each segment as one group: its lines, all in one partition."""
    found = file_groups.load_groups(spark, _segments(spark, sf), F.regexp_extract(F.url_decode("file"), _SEGMENT, 1))
    placed = found.withColumn("partition", F.spark_partition_id())
    return placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.countDistinct("partition").alias("partitions"), F.min(F.struct("file", "offset", "line"))["line"].alias("first"))


def user_partitions(spark, sf):
    """Three partitions a file, each with every third of its lines."""

    def load(path, number):
        f = Ranged(path)
        try:
            for i, (*_, line) in enumerate(text_ranges.lines(f, 0, f.size)):
                if i % 3 == number:
                    yield (line.decode(),)
        finally:
            f.close()

    found = file_groups.load_partitions(spark, _segments(spark, sf), F.array(*(F.lit(i) for i in range(3))), load, "line string")
    return found.groupBy(F.regexp_extract(F.url_decode("file"), r"([^/]+)\.txt$", 1).alias("name"), "partition").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))


def split_and_merge(spark, sf):
    """Names in capitals, made split by split and merged to a file an input."""
    out = indexed.new_folder(spark, "merged")
    done = file_groups.split_and_merge(spark, _segments(spark, sf), out, lambda found: (line.upper() for line in found), file_groups.even_splits(1_000))
    name = F.regexp_extract(F.url_decode("file"), r"([^/]+)\.txt$", 1).alias("name")
    made = lines.read_binary(spark, f"{out}/*.txt").select(F.regexp_extract(F.url_decode("path"), r"([^/]+)\.txt$", 1).alias("name"), F.md5("content").alias("body_md5"))
    return done.select(name, F.col("rows").alias("n"), "bytes").join(made, "name")


def attach_piped(spark, sf):
    """Names with a side file that a command made of every second one."""
    path = _segments(spark, sf)
    bare = attachments.load_text(spark, path, [])
    value = F.when(F.col("line_no") % 2 == 0, F.col("line"))
    attachments.pipe_attach(bare, value, "tr a-z A-Z", "capitals")
    found = attachments.load_text(spark, path, ["capitals"])
    return found.select("line", F.col("capitals.content").alias("content"), F.col("capitals.status").alias("status"))


QUERIES = {f.__name__: f for f in (charset_pages, named_binary_files, named_file_parts, text_splits_by_bytes, text_splits_by_groups, text_parts, file_group_lines, user_partitions, split_and_merge, attach_piped)}

_NAMES = """n AS (SELECT c_custkey, c_name, c_mktsegment, c_mktsegment || '-' || (c_custkey % 2) AS name,
    row_number() OVER (PARTITION BY c_mktsegment, c_custkey % 2 ORDER BY c_custkey) - 1 AS i FROM customer)"""
ORACLES = {
    "charset_pages": """SELECT page_id, md5(CASE WHEN page_id % 2 = 0 THEN '<meta charset="iso-8859-1">' ELSE '<?xml version="1.0" encoding="utf-8"?>' END
        || chr(10) || regexp_replace(html, '\\n$', '')) AS text_md5 FROM pages""",
    "named_binary_files": """SELECT source || '/' || lang AS name, sum(strlen(text))::BIGINT AS bytes, md5(string_agg(text, '' ORDER BY doc_id)) AS body_md5
        FROM documents GROUP BY 1""",
    "named_file_parts": _FOLD.format(lane="source", ord="doc_id", cost="strlen(text)", src="documents", budget=30_000)
    + " SELECT lane AS source, bin, md5(string_agg(text, '' ORDER BY doc_id)) AS body_md5 FROM b JOIN documents ON doc_id = ord GROUP BY 1, 2",
    "text_splits_by_bytes": _FOLD.format(lane="0", ord="doc_id", cost="strlen(text) + 1", src="documents", budget=100_000)
    + " SELECT bin, md5(string_agg(replace(text, chr(10), ' ') || chr(10), '' ORDER BY doc_id)) AS body_md5 FROM b JOIN documents ON doc_id = ord GROUP BY 1",
    "text_splits_by_groups": _FOLD.format(lane="0", ord="o_custkey", cost="n", src="(SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)", budget=500)
    + " SELECT bin, md5(string_agg(o_orderkey || chr(10), '' ORDER BY o_custkey, o_orderkey)) AS body_md5 FROM b JOIN orders ON o_custkey = ord GROUP BY 1",
    "text_parts": "SELECT c_name, count(*) OVER () AS first, 0::BIGINT AS again FROM customer",
    "file_group_lines": f"""WITH {_NAMES} SELECT c_mktsegment AS "group", count(*) AS n, count(DISTINCT name) AS files, 1 AS partitions,
        first(c_name ORDER BY name, c_custkey) AS first FROM n GROUP BY 1""",
    "user_partitions": f"WITH {_NAMES} SELECT name, (i % 3)::INT AS partition, count(*) AS n, min(c_name) AS first FROM n GROUP BY 1, 2",
    "split_and_merge": f"""WITH {_NAMES} SELECT name, count(*) AS n, sum(strlen(c_name) + 1)::BIGINT AS bytes,
        md5(string_agg(upper(c_name) || chr(10), '' ORDER BY c_custkey)) AS body_md5 FROM n GROUP BY 1""",
    "attach_piped": f"""WITH {_NAMES} SELECT c_name AS line, CASE WHEN i % 2 = 0 THEN upper(c_name) END AS content,
        CASE WHEN i % 2 = 0 THEN 'Available' ELSE 'Unavailable' END AS status FROM n""",
}
