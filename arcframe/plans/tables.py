"""Input tables of the registered queries, and capture rows derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcframe.operators import cdx, layout

KEYS = ("surt", "digest", "compressed_size")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, url, ts14, mime, status, keys of the body): a base capture of every page, and every event on the page its user id falls on.

    Pages are numbered in the order of page_id, so ids with gaps lose no event.
    """
    keyed = cdx.body_keys(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body")))
    pages = layout.dense_ids(keyed, ["page_id"], "__index")
    count = pages.count()
    base = pages.select(F.lit(None).cast("long").alias("event_id"), "url", F.lit(BASE_TS14).alias("ts14"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), *KEYS)
    events = table(spark, sf_dir, "events").withColumn("__index", F.pmod("user_id", F.lit(count))).withColumn("ts14", F.date_format("ts", "yyyyMMddHHmmss"))
    status = F.when(F.col("event_type") == "error", 404).otherwise(200)
    mime = F.when(F.col("event_type") == "click", "text/plain").otherwise("text/html")
    return base.unionByName(events.join(pages, "__index").select("event_id", "url", "ts14", mime.alias("mime"), status.alias("status"), *KEYS))


#: Time of the base capture of every page.
BASE_TS14 = "20240101000000"

#: SURT pieces of a URL in SQL (the test pages have no user, port or escapes).
HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
REVERSED_SQL = "array_to_string(list_reverse(string_split(regexp_replace(" + HOST_SQL + r", '^www\d*\.', ''), '.')), ',')"
PATH_SQL = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
QUERY_SQL = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
SURT_SQL = f"""lower({REVERSED_SQL} || ')' ||
    CASE WHEN {PATH_SQL} IN ('', '/') THEN '/' ELSE regexp_replace({PATH_SQL}, '/$', '') END ||
    CASE WHEN {QUERY_SQL} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({QUERY_SQL}, '&')), '&') END)"""
