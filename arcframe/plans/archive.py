"""Queries over HTML, captures, graphs and derivatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from arcframe.functions import surt
from arcframe.operators import attachments, cdx, derive, graph, html
from arcframe.plans.tables import BASE_TS14, HOST_SQL, SURT_SQL, all_captures, table
from arcframe.session import stored


def outlinks(spark, sf):
    return html.outlinks(table(spark, sf, "pages").where(html.strict_html(F.col("html")).isNotNull()), labels=False)


def host_graph(spark, sf):
    links = html.outlinks(table(spark, sf, "pages").where(html.strict_html(F.col("html")).isNotNull()), labels=False)
    pairs = links.groupBy("url", "target").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(surt.url_host(F.col("url")).alias("src_host"), surt.url_host(F.col("target")).alias("dst_host")).agg(F.sum("n").alias("links"))


def outlink_targets(spark, sf):
    found = html.outlinks(table(spark, sf, "pages"))
    return found.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))


def _edges(spark, sf):
    """Links between keys, written once: nodes and adjacency both read them."""
    found = html.outlinks(table(spark, sf, "pages"), labels=False).distinct()
    return stored(graph.links(found.select(F.col("url").alias("src_url"), F.lit("20240101000000").alias("ts14"), F.col("target").alias("dst_url"))), "edges")


def _nodes(spark, sf, edges):
    sources = table(spark, sf, "pages").select(surt.surt(F.col("url")).alias("src_surt"), F.col("url").alias("src_url"))
    return graph.nodes(edges, sources)


def link_nodes(spark, sf):
    return _nodes(spark, sf, _edges(spark, sf))


def link_adjacency(spark, sf):
    edges = _edges(spark, sf)
    adjacent = graph.adjacency(edges, _nodes(spark, sf, edges))
    return adjacent.select("src_id", "ts14", F.array_join("dst_ids", ",").alias("dst_ids"))


def json_nodes(spark, sf):
    return link_nodes(spark, sf).select(graph.node_json().alias("json"))


def json_adjacency(spark, sf):
    edges = _edges(spark, sf)
    return graph.adjacency(edges, _nodes(spark, sf, edges)).select(graph.adjacency_json().alias("json"))


def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.title(F.col("html")).alias("title"))


def html_tag_counts(spark, sf):
    tags = table(spark, sf, "pages").select(F.explode(html.opening_tags(F.col("html"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def html_attr_values(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.attribute(F.regexp_extract("html", "<html[^>]*>", 0), "lang").alias("lang"))


def html_comments_removed(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(html.without_comments(F.col("html"))).alias("md5"))


def html_scripts_removed(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(html.without_scripts(F.col("html"))).alias("md5"))


def html_body_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.body(F.col("html")).alias("text"))


def html_tag_stream(spark, sf):
    tags = table(spark, sf, "pages").select("page_id", F.posexplode(html.tag_stream(F.col("html"))).alias("ordinal", "t"))
    return tags.select("page_id", "ordinal", "t.name", "t.opening", F.size("t.stack").alias("depth"))


def html_embeds(spark, sf):
    """Embeds of the pages whose links are turned into images, as the given pages embed nothing."""
    pages = table(spark, sf, "pages").withColumn("html", F.regexp_replace("html", r"<a\s([^>]*)href", "<img $1src"))
    return pages.select("page_id", F.explode(html.embeds(F.col("html"), F.col("url"))).alias("target"))


def html_css_js(spark, sf):
    """Targets in all style and script blocks of a page, and in a sheet and a script that name its links."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href *= *"([^"]*)"'), F.lit(1))
    blocks = lambda name: F.regexp_extract_all("html", F.lit(rf"(?is)<{name}[^>]*>(.*?)</{name}>"), F.lit(1))
    css = F.concat_ws("\n", blocks("style"), F.transform(links, lambda x: F.concat(F.lit('@import url("'), x, F.lit('");'))))
    js = F.concat_ws("\n", blocks("script"), F.transform(links, lambda x: F.concat(F.lit('load("'), x, F.lit('");'))))
    pages = table(spark, sf, "pages").select("page_id", html.css_embeds(css, F.col("url")).alias("css"), html.script_urls(js, F.col("url")).alias("js"))
    return pages.select("page_id", F.explode(F.create_map(F.lit("css"), "css", F.lit("js"), "js")).alias("kind", "targets")).select("page_id", "kind", F.explode("targets").alias("target"))


def cdx_emit(spark, sf):
    return cdx.from_captures(all_captures(spark, sf)).select("surt", "ts14", cdx.line().alias("line"))


def cdx_parse(spark, sf):
    lines = cdx.from_captures(all_captures(spark, sf)).select(cdx.line().alias("value"))
    return cdx.parse(lines).select("surt", "ts14", "url", "mime", "status", "digest", "compressed_size")


def cdx_status_mime(spark, sf):
    return cdx.html_pages(cdx.from_captures(all_captures(spark, sf))).groupBy("surt").agg(F.count(F.lit(1)).alias("captures"))


def cdx_latest_capture(spark, sf):
    return cdx.latest(cdx.from_captures(all_captures(spark, sf)).select("surt", "ts14", "digest"))


def cdx_digest_dedup(spark, sf):
    return cdx.first_of_digest(cdx.from_captures(all_captures(spark, sf)).select("surt", "digest", "ts14", "url")).select("surt", "digest", "ts14")


def cdx_prefix_scan(spark, sf):
    prefixes = spark.createDataFrame([("com,example,",), ("com,example,th",), ("com,example,t",)], "prefix string")
    return cdx.scan(cdx.from_captures(all_captures(spark, sf)).select("surt", "ts14"), prefixes).groupBy("surt", "matched").agg(F.count(F.lit(1)).alias("n"))


def lang_blocks(spark, sf):
    return derive.block_languages(table(spark, sf, "documents"), "doc_id", "text")


def entity_sets(spark, sf):
    names = {"locations": dict.fromkeys(["and", "der", "les"]), "persons": dict.fromkeys(["The", "Der"]), "organizations": {}}
    found = derive.entity_sets(table(spark, sf, "documents"), "text", derive.gazetteer(names))
    return found.select("doc_id", F.to_json("entities").alias("entities"))


def pipe_upper(spark, sf):
    return derive.pipe(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "tr a-z A-Z")


def _side(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("file"), "doc_id", F.sha1("text").alias("checksum"))
    labels = table(spark, sf, "labels")
    both = docs.join(labels, "doc_id", "left")
    content = F.when(F.col("toxic").isNotNull(), F.concat_ws("/", "toxic", "quality"))
    return both.select("file", F.col("doc_id").alias("line_no"), "checksum", content.alias("content"))


def attach_zip(spark, sf):
    rows = _side(spark, sf)
    changed = rows.withColumn("checksum", F.when(F.col("line_no") % 10 == 3, F.lit("other")).otherwise(F.col("checksum")))
    return attachments.aligned(rows, attachments.side_lines(changed))


def attach_walk(spark, sf):
    rows = _side(spark, sf)
    return attachments.zipped(rows, attachments.side_lines(rows.where("content is not null")))


QUERIES = {f.__name__: f for f in (outlinks, host_graph, outlink_targets, link_nodes, link_adjacency, json_nodes, json_adjacency, html_title, html_tag_counts, html_attr_values, html_comments_removed, html_scripts_removed, html_body_text, html_tag_stream, html_embeds, html_css_js, cdx_emit, cdx_parse, cdx_status_mime, cdx_latest_capture, cdx_digest_dedup, cdx_prefix_scan, lang_blocks, entity_sets, pipe_upper, attach_zip, attach_walk)}


#: Second names of the CDX queries, from when only these read all pages.
ALL_PAGES = {f"{f.__name__}_all_pages": f for f in (cdx_emit, cdx_parse, cdx_status_mime, cdx_latest_capture, cdx_digest_dedup, cdx_prefix_scan)}
QUERIES |= ALL_PAGES

_LINKS = r"""l AS (SELECT url, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href AS target
    FROM (SELECT url, unnest(regexp_extract_all(html, '<a\s[^>]*href *= *[''"]([^''"]*)[''"]', 1)) AS href FROM pages) WHERE href LIKE '/%' AND href NOT LIKE '//%')"""
_HREFS = r"""h AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, '<a\s[^>]*href *= *"([^"]*)"', 1)) AS href FROM pages)"""
_DST = SURT_SQL.replace("url", "target")
_VALID = r"regexp_matches({0}, '^[a-z]+,[\p{{L}}\p{{M}}0-9,-]+$') AND NOT contains({0}, '--') AND NOT contains({0}, ',,')"
_GRAPH = f"""{_LINKS},
    e AS (SELECT s.src_surt, s.src_url, d.dst_surt, first(s.target ORDER BY length(s.target), s.target) AS dst_url FROM
          (SELECT url AS src_url, {SURT_SQL} AS src_surt, target FROM l) s JOIN (SELECT DISTINCT target, {_DST} AS dst_surt FROM l) d USING (target)
          WHERE {_VALID.format("split_part(d.dst_surt, ')', 1)")} GROUP BY 1, 2, 3),
    u AS (SELECT dst_surt AS surt, dst_url AS url FROM e UNION ALL SELECT {SURT_SQL}, url FROM pages),
    c AS (SELECT surt, count(*) AS count, first(url ORDER BY length(url), url) AS url, split_part(surt, ')', 1) AS host FROM u GROUP BY surt),
    v AS (SELECT *, sum(count) OVER (PARTITION BY host) AS host_count FROM c WHERE {_VALID.format("host")}),
    n AS (SELECT surt, url, host, count, row_number() OVER (ORDER BY host_count DESC, host, count DESC, surt) - 1 AS id FROM v),
    a AS (SELECT s.id AS src_id, '20240101000000' AS ts14, list_sort(list(DISTINCT t.id)) AS ids FROM e JOIN n s ON s.surt = e.src_surt JOIN n t ON t.surt = e.dst_surt GROUP BY 1)"""
_BASE32 = """list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(html), 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), lambda a, b: a || b)"""
_CDX = f"""WITH k AS (SELECT url, {SURT_SQL} AS surt, {_BASE32} AS digest, strlen(html) AS compressed_size,
           row_number() OVER (ORDER BY page_id) - 1 AS number, count(*) OVER () AS pages FROM pages),
    cdx AS (SELECT surt, '{BASE_TS14}' AS ts14, url, 'text/html' AS mime, 200 AS status, digest, compressed_size FROM k UNION ALL
            SELECT surt, strftime(e.ts, '%Y%m%d%H%M%S'), url, CASE WHEN e.event_type = 'click' THEN 'text/plain' ELSE 'text/html' END,
                   CASE WHEN e.event_type = 'error' THEN 404 ELSE 200 END, digest, compressed_size
            FROM events e JOIN k ON e.user_id % k.pages = k.number)"""
# Stop words by language as the Column expression has them; ties go to the first name.
_HITS = {name: "len(list_filter(tokens, lambda t: t IN (" + ", ".join(f"'{w}'" for w in words) + ")))" for name, words in sorted(derive.STOP_WORDS.items())}
_BEST = "greatest(" + ", ".join(_HITS.values()) + ")"
_LANG = f"CASE WHEN {_BEST} > 0 THEN CASE " + " ".join(f"WHEN {hits} = {_BEST} THEN '{name}'" for name, hits in _HITS.items()) + " END END"
_FOUND = "list_sort(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w IN ({}))))"
_SIDE = """s AS (SELECT source AS file, doc_id AS line_no, sha1(text) AS checksum, toxic || '/' || quality AS content FROM documents LEFT JOIN labels USING (doc_id))"""
ORACLES = {
    "outlinks": f"WITH {_LINKS} SELECT url, target FROM l",
    "host_graph": f"WITH {_LINKS} SELECT {HOST_SQL} AS src_host, {HOST_SQL.replace('url', 'target')} AS dst_host, count(*) AS links FROM l GROUP BY 1, 2",
    "link_nodes": f"WITH {_GRAPH} SELECT surt, url, host, count, id FROM n",
    "link_adjacency": f"WITH {_GRAPH} SELECT src_id, ts14, array_to_string(ids, ',') AS dst_ids FROM a",
    "json_nodes": f"""WITH {_GRAPH} SELECT '{{"surt_url":"' || surt || '","url":"' || url || '","id":' || id || '}}' AS json FROM n""",
    "json_adjacency": f"""WITH {_GRAPH} SELECT '{{"id":' || src_id || ',"timestamp":"' || ts14 || '","outlink_ids":[' || array_to_string(ids, ',') || ']}}' AS json FROM a""",
    "html_title": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages",
    "html_tag_counts": "SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1",
    "html_attr_values": """SELECT page_id, nullif(regexp_extract(regexp_extract(html, '<html[^>]*>'), 'lang *= *"([^"]*)"', 1), '') AS lang FROM pages""",
    "html_comments_removed": "SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS md5 FROM pages",
    "html_scripts_removed": "SELECT page_id, md5(regexp_replace(html, '(?is)<script.*?</script>', '', 'g')) AS md5 FROM pages",
    "html_embeds": f"WITH {_HREFS} SELECT DISTINCT page_id, root || href AS target FROM h",
    "html_css_js": f"""WITH {_HREFS} SELECT DISTINCT page_id, 'css' AS kind, root || href AS target FROM h UNION ALL
        SELECT DISTINCT page_id, 'js', root || href FROM h WHERE length(href) > 2 AND regexp_matches(href, '^/[A-Za-z0-9_]') AND NOT contains(href, ' ')""",
    "cdx_emit": _CDX + " SELECT surt, ts14, surt || ' ' || ts14 || ' ' || url || ' ' || mime || ' ' || status || ' ' || digest || ' - - ' || compressed_size AS line FROM cdx",
    "cdx_parse": _CDX + " SELECT surt, ts14, url, mime, status, digest, compressed_size FROM cdx",
    "cdx_status_mime": _CDX + " SELECT surt, count(*) AS captures FROM cdx WHERE status = 200 AND mime = 'text/html' GROUP BY surt",
    "cdx_latest_capture": _CDX + " SELECT surt, max(ts14) AS ts14, first(digest ORDER BY ts14 DESC, digest) AS digest FROM cdx GROUP BY surt",
    "cdx_digest_dedup": _CDX + " SELECT surt, digest, min(ts14) AS ts14 FROM cdx GROUP BY surt, digest",
    "cdx_prefix_scan": _CDX + """ SELECT surt, p AS matched, count(*) AS n FROM (SELECT surt, ts14,
        CASE WHEN starts_with(surt, 'com,example,th') THEN 'com,example,th' WHEN starts_with(surt, 'com,example,t') THEN 'com,example,t'
             WHEN starts_with(surt, 'com,example,') THEN 'com,example,' END AS p FROM cdx) WHERE p IS NOT NULL GROUP BY surt, p""",
    "lang_blocks": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
        t AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(line), '[^\\p{{L}}\\p{{M}}0-9]+'), lambda x: x <> '') AS tokens FROM l),
        m AS (SELECT *, CASE WHEN len(tokens) < {derive.LEAST_TERMS} AND lag(len(tokens)) OVER w < {derive.LEAST_TERMS} THEN 0 ELSE 1 END AS new
              FROM t WHERE len(tokens) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM m),
        b AS (SELECT doc_id, flatten(list(tokens ORDER BY line_no)) AS tokens FROM k GROUP BY doc_id, block),
        g AS (SELECT doc_id, {_LANG} AS lang, (len(tokens) * len(tokens))::DOUBLE AS weight FROM b WHERE len(tokens) >= {derive.LEAST_TERMS})
        SELECT doc_id, lang, share FROM (SELECT doc_id, lang, sum(weight) / sum(sum(weight)) OVER (PARTITION BY doc_id) AS share FROM g GROUP BY 1, 2) WHERE lang IS NOT NULL""",
    "entity_sets": f"""SELECT doc_id, to_json({{'locations': {_FOUND.format("'and', 'der', 'les'")}, 'organizations': []::VARCHAR[], 'persons': {_FOUND.format("'The', 'Der'")}}})::VARCHAR AS entities
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
    "pipe_upper": "SELECT c_custkey, c_mktsegment, upper(c_mktsegment) AS piped FROM customer",
    "attach_zip": f"""WITH {_SIDE} SELECT file, line_no, checksum, content,
        CASE WHEN content IS NULL THEN 'Unavailable' WHEN line_no % 10 = 3 THEN 'ChecksumMismatch' ELSE 'Available' END AS status FROM s""",
    "attach_walk": f"""WITH RECURSIVE {_SIDE},
        r AS (SELECT file, line_no, checksum, row_number() OVER (PARTITION BY file ORDER BY line_no) AS t FROM s),
        q AS (SELECT file, checksum AS head, content, row_number() OVER (PARTITION BY file ORDER BY line_no) AS p FROM s WHERE content IS NOT NULL),
        w AS (SELECT DISTINCT file, 0::BIGINT AS t, 1::BIGINT AS p FROM r UNION ALL
              SELECT r.file, r.t, w.p + CASE WHEN q.head = r.checksum THEN 1 ELSE 0 END
              FROM w JOIN r ON r.file = w.file AND r.t = w.t + 1 LEFT JOIN q ON q.file = w.file AND q.p = w.p)
        SELECT r.file, r.line_no, r.checksum, q.content,
               CASE WHEN q.head IS NULL THEN 'Unavailable' WHEN q.head = r.checksum THEN 'Available' ELSE 'ChecksumMismatch' END AS status
        FROM r JOIN w ON w.file = r.file AND w.t = r.t - 1 LEFT JOIN q ON q.file = r.file AND q.p = w.p""",
}
ORACLES |= {name: ORACLES[f.__name__] for name, f in ALL_PAGES.items()}
