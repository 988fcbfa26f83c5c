"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcframe.functions import digest, surt, text, time14
from arcframe.plans.tables import HOST_SQL, REVERSED_SQL, SURT_SQL, table


def page_host_freq(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.groupBy(surt.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.min_by("url", F.struct(F.char_length("url"), "url")).alias("url"))


def page_surt(spark, sf):
    return table(spark, sf, "pages").select("page_id", surt.surt(F.col("url")).alias("surt"))


def surt_host_valid(spark, sf):
    host = surt.surt_host(surt.surt(F.col("url")))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), surt.is_valid_host(host).alias("valid"))


def surt_to_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", surt.surt_to_url(surt.surt(F.col("url"))).alias("url"))


def surt_prefixes(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(surt.url_prefixes(F.col("url"))).alias("prefix"))
    return rows


def doc_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.explode(text.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def doc_clean_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.one_line(F.col("text"))).alias("line_md5"))


def doc_long_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length(text.remove_long_words(F.col("text"), 12)).cast("long").alias("chars"))


def doc_digests(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", digest.md5_hex(t).alias("md5"), digest.sha1_hex(t).alias("sha1"))


def doc_sha1_base32(spark, sf):
    return table(spark, sf, "documents").select("doc_id", digest.sha1_base32(F.col("text")).alias("digest"))


def doc_bytes_fmt(spark, sf):
    n = F.octet_length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", text.format_bytes(n).alias("size"))


def string_edges(spark, sf):
    name = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey",
        text.before(name, "#").alias("head"),
        text.after(name, "#").alias("tail"),
        text.strip_prefix(name, "CUSTOMER").alias("bare"),
        text.strip_suffix(F.col("c_mktsegment"), "ing").alias("stem"),
        text.pad_number(F.col("c_nationkey"), 4).alias("nation"),
        text.pad_number(F.col("c_custkey"), 2).alias("uncut"),
    )


def ts14_fix_parse(spark, sf):
    ts = F.date_format("ts", "yyyyMMddHHmmss")
    cut = F.substring(ts, F.lit(1), (F.lit(4) + 2 * (F.col("event_id") % 6)).cast("int"))
    return table(spark, sf, "events").select("event_id", time14.fix(cut).alias("fixed"), time14.is_valid(cut).alias("valid"))


def ts14_bucket(spark, sf):
    day = F.substring(F.date_format("ts", "yyyyMMddHHmmss"), 1, 8)
    return table(spark, sf, "events").groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def endian_numbers(spark, sf):
    raw = F.unhex(F.substring(F.md5("text"), 1, 8))
    return table(spark, sf, "documents").select("doc_id", digest.big_endian(raw).alias("big"), digest.little_endian(raw).alias("little"))


QUERIES = {f.__name__: f for f in (page_host_freq, page_surt, surt_host_valid, surt_to_url, surt_prefixes, doc_tokens, doc_clean_ws, doc_long_words, doc_digests, doc_sha1_base32, doc_bytes_fmt, string_edges, ts14_fix_parse, ts14_bucket, endian_numbers)}

_HEX8 = "('0x' || {})::BIGINT"
ORACLES = {
    "page_host_freq": f"""
        SELECT host, count(*) AS pages, first(url ORDER BY length(url), url) AS url
        FROM (SELECT url, {HOST_SQL} AS host FROM pages) GROUP BY host""",
    "page_surt": f"SELECT page_id, {SURT_SQL} AS surt FROM pages",
    "surt_host_valid": f"""
        SELECT page_id, host, regexp_matches(host, '^[a-z]+,[\\p{{L}}\\p{{M}}0-9,-]+$') AND NOT contains(host, '--')
               AND NOT contains(host, ',,') AND NOT contains(host, ',-') AND NOT contains(host, '-,')
               AND NOT ends_with(host, '-') AND NOT ends_with(host, ',') AS valid
        FROM (SELECT page_id, {REVERSED_SQL} AS host FROM pages)""",
    "surt_to_url": f"""
        SELECT page_id, 'http://' || array_to_string(list_reverse(string_split(split_part(k, ')', 1), ',')), '.') || substr(k, strpos(k, ')') + 1) AS url
        FROM (SELECT page_id, {SURT_SQL} AS k FROM pages)""",
    "surt_prefixes": f"""
        WITH k AS (SELECT page_id, {SURT_SQL} AS k FROM pages),
             h AS (SELECT page_id, split_part(k, ')', 1) AS site, trim(regexp_replace(regexp_replace(substr(k, strpos(k, ')') + 1), '^/', ''), '/$', '')) AS path FROM k),
             p AS (SELECT unnest(['', ':80', ':443']) AS port), e AS (SELECT unnest([' ', '?', '#', '/']) AS e)
        SELECT page_id, site || port || ')/' || path || e AS prefix FROM h, p, e WHERE path <> '' AND (e = ' ' OR NOT contains(path, '?'))
        UNION ALL SELECT page_id, site || port || ')' FROM h, p WHERE path = ''
        UNION ALL SELECT page_id, site || ',' FROM h WHERE path = ''""",
    "doc_tokens": r"""
        SELECT token, count(*) AS n FROM (
            SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}0-9]+', ' ', 'g')), ' ')) AS token FROM documents)
        GROUP BY token""",
    "doc_clean_ws": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS line_md5 FROM documents",
    "doc_long_words": r"SELECT doc_id, length(regexp_replace(text, '[^ \t\n\r\f\x0B]{12,}', '', 'g')) AS chars FROM documents",
    "doc_digests": "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents",
    "doc_sha1_base32": """
        SELECT doc_id, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), lambda a, b: a || b) AS digest
        FROM (SELECT doc_id, sha1(text) AS h FROM documents)""",
    "doc_bytes_fmt": """
        SELECT doc_id, CASE WHEN n > 1048576 THEN format('{:.1f}', floor(n * 10 / 1048576.0 + 0.5) / 10) || ' MB'
                            WHEN n > 1024 THEN format('{:.1f}', floor(n * 10 / 1024.0 + 0.5) / 10) || ' KB' ELSE n || ' bytes' END AS size
        FROM (SELECT doc_id, strlen(text) AS n FROM documents)""",
    "string_edges": """
        SELECT c_custkey, split_part(c_name, '#', 1) AS head,
               CASE WHEN contains(c_name, '#') THEN substr(c_name, strpos(c_name, '#') + 1) ELSE c_name END AS tail,
               CASE WHEN lower(left(c_name, 8)) = 'customer' THEN substr(c_name, 9) ELSE c_name END AS bare,
               CASE WHEN ends_with(lower(c_mktsegment), 'ing') THEN left(c_mktsegment, length(c_mktsegment) - 3) ELSE c_mktsegment END AS stem,
               lpad(c_nationkey::VARCHAR, 4, '0') AS nation, lpad(c_custkey::VARCHAR, greatest(2, length(c_custkey::VARCHAR))::INT, '0') AS uncut
        FROM customer""",
    "ts14_fix_parse": """
        SELECT event_id, x || substr('20000101000000', length(x) + 1) AS fixed,
               try_strptime(x || substr('20000101000000', length(x) + 1), '%Y%m%d%H%M%S') IS NOT NULL AS valid
        FROM (SELECT event_id, left(strftime(ts, '%Y%m%d%H%M%S'), (4 + 2 * (event_id % 6))::INT) AS x FROM events)""",
    "ts14_bucket": "SELECT strftime(ts, '%Y%m%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "endian_numbers": f"""
        SELECT doc_id, {_HEX8.format("left(m, 8)")} AS big,
               {_HEX8.format("substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2)")} AS little
        FROM (SELECT doc_id, md5(text) AS m FROM documents)""",
}
