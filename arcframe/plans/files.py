"""Queries that write files to the shared folder and read them back, and further functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arcframe.functions import text, url
from arcframe.operators import cdx, derive, html, joins, layout
from arcframe.plans.archive import _BASE32, _CDX, _DST, _LINKS
from arcframe.plans.tables import SURT_SQL, all_captures, table
from arcframe.sources import captures, http, indexed, lines, warc

HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: "


def _archive(spark, sf):
    """A WARC archive with a response record per page."""
    warc.register(spark)
    path = indexed.new_folder(spark, "warc")
    field = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    headers = F.array(
        field("WARC-Type", F.lit("response")), field("WARC-Target-URI", F.col("url")), field("WARC-Date", F.lit("2024-01-01T00:00:00Z")), field("Content-Type", F.lit("application/http; msgtype=response"))
    )
    payload = F.encode(F.concat(F.lit(HEAD), F.col("page_id").cast("string"), F.lit("\r\n\r\n"), F.col("html")), "utf-8")
    place = (F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))
    table(spark, sf, "pages").select(*place, F.lit("WARC/1.0").alias("version"), headers.alias("headers"), payload.alias("payload")).write.format("warc").mode("append").save(path)
    return path


def _records(spark, path, mode="records"):
    return spark.read.format("warc").option("mode", mode).load(path)


def warc_load(spark, sf):
    found = warc.with_fields(_records(spark, _archive(spark, sf)))
    return found.select("url", "version", "type", "ts14", "content_type", F.octet_length("payload").cast("long").alias("bytes"))


def warc_http(spark, sf):
    found = _records(spark, _archive(spark, sf)).select(http.parsed(F.col("payload")).alias("h"))
    return found.select(
        F.col("h.headers")["x-page"].cast("long").alias("page_id"), "h.status", "h.mime", "h.charset", F.md5("h.body").alias("body_md5"), F.md5("h.body_string").alias("text_md5"), "h.status_line"
    )


def warc_cdx(spark, sf):
    return warc.to_cdx(_records(spark, _archive(spark, sf))).select("surt", "ts14", "url", "mime", "status", "digest", "redirect")


def warc_raw(spark, sf):
    rows = _records(spark, _archive(spark, sf), "raw")
    whole = F.octet_length("payload") == F.col("length")
    packed = F.hex(F.substring("payload", 1, 2)) == "1F8B"
    before = F.sum("length").over(Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    placed = F.col("offset") == F.coalesce(F.col("before"), F.lit(0))
    return rows.withColumn("before", before).agg(F.count(F.lit(1)).alias("records"), F.count_if(whole).alias("whole"), F.count_if(packed).alias("packed"), F.count_if(placed).alias("placed"))


def warc_extract(spark, sf):
    """CDX of an archive, and the records of captures over https by their pointers."""
    found = warc.to_cdx(_records(spark, _archive(spark, sf))).where("url like 'https:%'")
    pointers = found.select(cdx.location().alias("at"), "compressed_size").select("at.file", "at.offset", F.col("compressed_size").alias("length"))
    records = warc.with_fields(warc.extract(pointers)).withColumn("h", http.parsed(F.col("payload")))
    return records.select("url", F.md5("h.body").alias("body_md5"))


def cdx_files(spark, sf):
    path = indexed.new_folder(spark, "cdx")
    captures.save(cdx.from_captures(all_captures(spark, sf)), path)
    return captures.load(spark, path).select("surt", "ts14", "url", "mime", "status", "digest", "compressed_size")


def _indexed_cdx(spark, sf):
    path = indexed.new_folder(spark, "cdx-index")
    captures.save_indexed(cdx.from_captures(all_captures(spark, sf)), path, 200)
    return path


def cdx_index_scan(spark, sf):
    prefixes = spark.createDataFrame([("com,example,",), ("com,example,th",), ("com,example,t",)], "prefix string")
    return captures.scan(spark, _indexed_cdx(spark, sf), prefixes).groupBy("surt", "matched").agg(F.count(F.lit(1)).alias("n"))


def cdx_lookup(spark, sf):
    """Captures of every linked key, by the index of all captures."""
    from arcframe.functions import surt

    keys = html.outlinks(table(spark, sf, "pages")).select(surt.surt(F.col("target")).alias("surt"))
    return captures.lookup(spark, _indexed_cdx(spark, sf), keys).groupBy("looked_up").agg(F.count(F.lit(1)).alias("captures"), F.max("ts14").alias("last"))


def prefix_long(spark, sf):
    """The longest of all texts' first 300 characters, or the empty prefix, that begins each text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    prefixes = docs.where(F.char_length("text") >= 300).select(F.substring("text", 1, 300).alias("p")).unionByName(spark.createDataFrame([("",)], "p string"))
    return joins.prefix_match(docs, "text", prefixes, "p").select("doc_id", F.md5("matched").alias("matched_md5"))


def doc_clean_latin(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.clean_latin(F.col("text"))).alias("md5"))


def doc_trim_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.trim_lines(F.col("text"))).alias("md5"))


def doc_fixpoint(spark, sf):
    """Two letters of one kind become one, until there are none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = text.to_fixpoint(docs, "text", lambda x: F.regexp_replace(x, r"ss", "s"))
    return done.select("doc_id", F.md5("text").alias("md5"))


def string_tests(spark, sf):
    u = F.col("url")
    parts = text.split_limited(u, "/", 4)
    return table(spark, sf, "pages").select(
        "page_id",
        text.is_absolute_url_start(u).alias("absolute"),
        text.has_word_character(F.regexp_extract(u, r"([^/]*)$", 1)).alias("worded"),
        F.size(parts).alias("parts"),
        F.element_at(parts, -1).alias("last"),
        text.strip_bracket(F.concat(F.lit("<"), u, F.lit(">")), "<", ">").alias("bare"),
        text.thousands(F.octet_length("html")).alias("size"),
        url.decode(url.encode(u)).alias("recoded"),
    )


def html_selected(spark, sf):
    return html.selected(table(spark, sf, "pages").select("page_id", "html"), ("title",)).select("page_id", "text")


def page_embed_urls(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.concat_ws(" ", html.embeds(F.col("html"), F.col("url"))).alias("embeds"), F.size(html.content_embeds(F.col("html"), F.col("url"))).alias("content"))


def lang_merged(spark, sf):
    return derive.block_languages(table(spark, sf, "documents"), "doc_id", "text")


def text_files(spark, sf):
    path = indexed.new_folder(spark, "text")
    lines.save_text(table(spark, sf, "customer"), "c_name", path, gzip=True)
    return lines.read_lines(spark, path).select("line")


def csv_files(spark, sf):
    path = indexed.new_folder(spark, "csv")
    lines.save_csv(table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", r"[\r\n\\]", " ").alias("line")), path)
    return spark.read.option("header", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5(F.coalesce("line", F.lit(""))).alias("line_md5"))


def named_files(spark, sf):
    path = indexed.new_folder(spark, "named")
    lines.save_named(table(spark, sf, "customer"), "c_mktsegment", "c_name", path, 2)
    return spark.read.text(path).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"))


def line_offsets(spark, sf):
    return lines.line_index(table(spark, sf, "documents").withColumn("part", F.col("lang")), "source", "text", "part").select("part", "source", "count", "offset", "length")


def sorted_layouts(spark, sf):
    """Rows, places where a partition is out of order, and keys in two partitions, of each layout."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    made = {
        "range": (layout.range_sort(rows, 8, ["l_orderkey"], ["l_linenumber"]), ["l_orderkey", "l_linenumber"]),
        "hash": (layout.hash_sort(rows, 8, ["l_suppkey"], ["l_orderkey", "l_linenumber"]), ["l_suppkey", "l_orderkey", "l_linenumber"]),
    }
    out = None
    for name, (df, by) in made.items():
        placed = df.select(*by, F.struct(*by).alias("k"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
        w = Window.partitionBy("part").orderBy("at")
        bad = placed.withColumn("bad", (F.lag("k").over(w) > F.col("k")).cast("int")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("out_of_order"))
        split = placed.groupBy(by[0]).agg(F.countDistinct("part").alias("parts")).agg(F.count_if(F.col("parts") > 1).alias("split_keys"))
        both = bad.join(F.broadcast(split)).select(F.lit(name).alias("layout"), "n", "out_of_order", "split_keys")
        out = both if out is None else out.unionByName(both)
    return out


def subtract_keys_whole(spark, sf):
    return joins.subtract_keys(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


QUERIES = {f.__name__: f for f in (warc_load, warc_http, warc_cdx, warc_raw, warc_extract, cdx_files, cdx_index_scan, cdx_lookup, prefix_long, doc_clean_latin, doc_trim_lines, doc_fixpoint, string_tests, html_selected, page_embed_urls, lang_merged, text_files, csv_files, named_files, line_offsets, sorted_layouts, subtract_keys_whole)}

_TRIM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{2,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""
#: Entities of the pages; the ampersand comes last, so that what it leaves is not read again.
_ENTITIES = {"middot": "·", "copy": "©", "quot": '"', "lt": "<", "gt": ">", "#39": "''", "nbsp": " ", "amp": "&"}
_PLAIN = "{}"
for _name, _sign in _ENTITIES.items():
    _PLAIN = f"replace({_PLAIN}, '&{_name};', '{_sign}')"
_PLAIN = rf"trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'))"
_WORDS = "\n             ".join(
    f"{'WHEN' if i else 'CASE WHEN'} {name} > 0 AND {name} = greatest(de, en, es, fr) THEN '{name}'" for i, name in enumerate(sorted(derive.STOP_WORDS))
)
_HITS = ", ".join(f"len(list_filter(tokens, lambda t: t IN ({', '.join(repr(w) for w in words)}))) AS {name}" for name, words in sorted(derive.STOP_WORDS.items()))
_TAGS = """'<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>''"]|''[^'']*''|"[^"]*")*)>|<!--.*?-->|<![^>]*>'"""
_BODY = r"regexp_extract(regexp_extract(html, '(?is)^(?:.*</head\s*>)?(.*)$', 1), '(?is)<body.*$')"
for _name in ("!--", "script", "style", "textarea", "pre"):
    _BODY = rf"regexp_replace({_BODY}, '(?is)<{_name}{r'.*?(-->|$)' if _name == '!--' else rf'\b.*?(</{_name}\s*>|$)'}', ' ', 'g')"
ORACLES = {
    "html_body_text": f"SELECT page_id, {_PLAIN.format(f'regexp_replace({_BODY}, {_TAGS}, chr(32), chr(103))')} AS text FROM pages",
    "outlink_targets": rf"""
        WITH a AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a>')) AS a FROM pages),
             t AS (SELECT regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || regexp_extract(a, 'href *= *[''"]([^''"]*)[''"]', 1) AS target,
                          {_PLAIN.format("regexp_replace(a, '<[^>]*>', ' ', 'g')")} AS label FROM a)
        SELECT target, count(*) AS n, min(label) AS label FROM t GROUP BY target""",
    "warc_load": f"""SELECT url, 'WARC/1.0' AS version, 'response' AS type, '20240101000000' AS ts14, 'application/http' AS content_type,
        {len(HEAD)} + length(page_id::VARCHAR) + 4 + strlen(html) AS bytes FROM pages""",
    "warc_http": """SELECT page_id, 200 AS status, 'text/html' AS mime, 'utf-8' AS charset, md5(html) AS body_md5, md5(html) AS text_md5, 'HTTP/1.1 200 OK' AS status_line FROM pages""",
    "warc_cdx": f"SELECT {SURT_SQL} AS surt, '20240101000000' AS ts14, url, 'text/html' AS mime, 200 AS status, {_BASE32} AS digest, '-' AS redirect FROM pages",
    "warc_raw": "SELECT count(*) AS records, count(*) AS whole, count(*) AS packed, count(*) AS placed FROM pages",
    "warc_extract": "SELECT url, md5(html) AS body_md5 FROM pages WHERE url LIKE 'https:%'",
    "cdx_files": _CDX + " SELECT surt, ts14, url, mime, status, digest, compressed_size FROM cdx",
    "cdx_index_scan": _CDX
    + """ SELECT surt, p AS matched, count(*) AS n FROM (SELECT surt, ts14,
        CASE WHEN starts_with(surt, 'com,example,th') THEN 'com,example,th' WHEN starts_with(surt, 'com,example,t') THEN 'com,example,t'
             WHEN starts_with(surt, 'com,example,') THEN 'com,example,' END AS p FROM cdx) WHERE p IS NOT NULL GROUP BY surt, p""",
    "cdx_lookup": _CDX + f", {_LINKS}, w AS (SELECT DISTINCT {_DST} AS looked_up FROM l) SELECT looked_up, count(*) AS captures, max(ts14) AS last FROM w JOIN cdx ON surt = looked_up GROUP BY 1",
    "prefix_long": "SELECT doc_id, md5(CASE WHEN length(text) >= 300 THEN left(text, 300) ELSE '' END) AS matched_md5 FROM documents",
    "doc_clean_latin": f"""SELECT doc_id, md5({_TRIM.format(r"regexp_replace(regexp_replace(text, '[^ \t\n\r\f\x0B]{100,}', '', 'g'), '[^\p{Latin}0-9 \t\n\r\f\x0B.,!?''" + '"' + r"()\-&;]+', ' ', 'g')")}) AS md5 FROM documents""",
    "doc_trim_lines": f"SELECT doc_id, md5({_TRIM.format('text')}) AS md5 FROM documents",
    "doc_fixpoint": "SELECT doc_id, md5(regexp_replace(text, 's{2,}', 's', 'g')) AS md5 FROM documents",
    "string_tests": r"""SELECT page_id, true AS absolute, regexp_matches(regexp_extract(url, '([^/]*)$', 1), '[\p{L}\p{M}]') AS worded,
        len(p) AS parts, p[-1] AS last, url AS bare, format('{:,}', strlen(html)) AS size, url AS recoded
        FROM (SELECT *, CASE WHEN len(q) < 4 AND q[-1] = '' THEN q[:-2] ELSE q END AS p FROM (SELECT *,
              CASE WHEN len(s) > 4 THEN list_append(s[1:3], array_to_string(s[4:], '/')) ELSE s END AS q FROM (SELECT *, string_split(url, '/') AS s FROM pages)))""",
    "html_selected": rf"SELECT page_id, {_PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS text FROM pages WHERE regexp_matches(html, '(?i)<title')",
    "lang_merged": rf"""
        WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
             t AS (SELECT doc_id, pos, list_filter(string_split_regex(lower(line), '[^\p{{L}}\p{{M}}0-9]+'), lambda x: x <> '') AS tokens FROM b),
             n AS (SELECT *, len(tokens) AS n FROM t WHERE len(tokens) > 0),
             m AS (SELECT *, CASE WHEN n < 10 AND lag(n) OVER (PARTITION BY doc_id ORDER BY pos) < 10 THEN 0 ELSE 1 END AS new FROM n),
             g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM m),
             k AS (SELECT doc_id, flatten(list(tokens ORDER BY pos)) AS tokens FROM g GROUP BY doc_id, block),
             h AS (SELECT doc_id, len(tokens) * len(tokens) AS weight, {_HITS} FROM k WHERE len(tokens) >= 10),
             l AS (SELECT doc_id, weight, {_WORDS} END AS lang FROM h)
        SELECT doc_id, lang, sum(weight)::DOUBLE / any_value(total) AS share FROM (SELECT *, (sum(weight) OVER (PARTITION BY doc_id))::DOUBLE AS total FROM l)
        WHERE lang IS NOT NULL GROUP BY doc_id, lang""",
    "text_files": "SELECT c_name AS line FROM customer",
    "csv_files": r"SELECT doc_id, lang, md5(regexp_replace(coalesce(text, ''), '[\r\n\\]', ' ', 'g')) AS line_md5 FROM documents",
    "named_files": "SELECT c_mktsegment AS name, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1",
    "line_offsets": """SELECT part, source, count, (sum(length) OVER (PARTITION BY part ORDER BY source) - length)::BIGINT AS offset, length::BIGINT AS length
        FROM (SELECT lang AS part, source, count(*) AS count, sum(strlen(text) + 1) AS length FROM documents GROUP BY ALL)""",
    "sorted_layouts": "SELECT unnest(['range', 'hash']) AS layout, (SELECT count(*) FROM lineitem) AS n, 0 AS out_of_order, 0 AS split_keys",
    "subtract_keys_whole": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
