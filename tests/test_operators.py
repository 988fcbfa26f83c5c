from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from arcframe.operators import attachments, budgets, cdx, derive, graph, groups, html, joins, layout


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_runs_keep_separate_groups(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("aabba")], "i int, k string").withColumn("p", F.lit(0))
    assert rows(groups.runs(df, "k", ["i"], ["p"]), "i", "run_id") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]
    assert rows(groups.adjacent_distinct(df, "k", ["i"], ["p"]), "i") == [(0,), (2,), (4,)]


def test_next_fit_invariants():
    rng = random.Random(3)
    for _ in range(50):
        costs = [rng.choice([0, 1, 5, 20, 70]) for _ in range(40)]
        bins = list(budgets.next_fit(costs, 50))
        assert bins == sorted(bins) and set(bins) == set(range(max(bins) + 1))
        for b in set(bins):
            held = [c for c, x in zip(costs, bins) if x == b]
            assert sum(held) <= 50 or len([c for c in held if c]) == 1


def test_prefix_match_is_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(60)]
    prefixes = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(8)})
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    known = spark.createDataFrame([(p,) for p in prefixes], "p string")
    want = [(i, max((p for p in prefixes if w.startswith(p)), key=len, default=None)) for i, w in enumerate(words)]
    assert rows(joins.prefix_match(df, "w", known, "p"), "i", "matched") == want


def test_prefix_that_is_no_prefix_never_matches(spark):
    df = spark.createDataFrame([("ab",)], "w string")
    known = spark.createDataFrame([("a",), ("aa",)], "p string")
    assert rows(joins.prefix_match(df, "w", known, "p"), "matched") == [("a",)]


def test_cogroup_is_a_full_outer_join(spark):
    a = spark.createDataFrame([(1, 2), (1, 1), (3, 9)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    both = joins.cogroup({"a": (a, "k", F.col("v")), "b": (b, "k", F.col("v"))})
    assert rows(both, "key", "a", "b") == [(1, [1, 2], [5]), (2, [], [6]), (3, [9], [])]


def test_dense_ids_have_no_gap(spark):
    df = layout.dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), [F.asc("v")])
    assert rows(df, "id", "v") == [(i, i) for i in range(1000)]


def test_uniform_partitions_hold_whole_keys(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 5), ("b", 2), ("c", 2), ("d", 4)) for i in range(n)], "k string, i int")
    assert rows(layout.uniform_bins(df, "k"), "k", "bin") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    placed = layout.repartition_uniform(df, "k").withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("p").alias("n"))
    assert rows(placed, "n") == [(1,)] * 4


def test_cdx_lines(spark):
    lines = ["k 20130101 u m 200 d 7", "k 20130101 u m 200 d r x 8", "k 20130101 u m 200 d r x 8 5 f", "a b c", "k 2013 u m x d - - - 1", "k 1 u m 200 d r x", "k 1 u m 200 d r x bad"]
    parsed = cdx.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = rows(parsed, "ts14", "status", "redirect", "compressed_size", "extra")
    assert got == [("2013", -1, "-", 0, ["1"]), ("20130101", 200, "-", 7, []), ("20130101", 200, "r", 8, []), ("20130101", 200, "r", 8, ["5", "f"])]
    again = cdx.parse(parsed.select(cdx.line().alias("value")))
    assert rows(again, "ts14", "status", "compressed_size", "extra") == rows(parsed, "ts14", "status", "compressed_size", "extra")
    assert rows(parsed.where("size(extra) = 2").select(cdx.location().alias("l")).select("l.*"), "file", "offset") == [("f", 5)]


PAGE = """<html><head><base href="http://b.org/q/"><title>T</title><link rel=stylesheet href="s.css"><link rel="stylesheet" href="t.css">
<style>@import 'i.css'; p{background:url(bg.png)}</style><script src='j.js'>var x = "</p>"; var u = "/a.js";</script></head>
<body background="w.gif"><!-- <a href="no">no</a> --><p>One &amp; two<a data-href="d" href='/x y'>Label  here</a></i><img src="p.png"/><form action="f"></form></body></html>"""


def test_html_kernel():
    links = html.page_links(PAGE, "http://a.com/")
    by = [(x["tag"], x["target"]) for x in links]
    assert ("link", "http://b.org/q/t.css") in by and ("script", "http://b.org/q/j.js") in by and ("form", "http://b.org/q/f") in by
    assert ("a", "http://b.org/q/d") in by  # the first attribute whose name ends in href
    assert "http://b.org/q/no" not in [t for _, t in by]
    embeds = html.page_embeds(PAGE, "http://a.com/")
    assert {"http://b.org/q/w.gif", "http://b.org/q/bg.png", "http://b.org/q/i.css", "http://b.org/q/p.png"} <= set(embeds)
    assert html.body_text(PAGE) == "One & two Label here" and html.body_text("<p>x</p>") == ""
    tags = list(html.iterate_tags(PAGE))
    assert [t["stack"] for t in tags if t["name"] == "a" and t["opening"]] == [["html", "body", "p"]]
    deep = list(html.iterate_tags("<i>" * 600))
    assert deep[-1]["error"] and len(deep) == html.MOST_DEPTH + 1
    assert html.js_targets("""f('/a.js', "x y", 'http://b/c', "ab", "(.)")""", "http://b/") == ["http://b/a.js", "http://b/c"]


def test_html_expressions(spark):
    df = spark.createDataFrame([("<A><!--x--><b><!-- open",), ("x-->rest",)], "h string")
    assert [r[0] for r in df.select(html.without_comments(F.col("h"))).collect()] == ["<A><b>", "rest"]
    assert spark.range(1).select(html.attribute(F.lit("<a data-href='d'>"), "href")).first()[0] == "d"
    assert spark.range(1).select(html.css_embeds(F.lit("a{b:url( 'x.png' )} @import \"y.css\"; @import 'no.css'"), F.lit("http://a/b/"))).first()[0] == ["http://a/b/x.png", "http://a/b/y.css"]
    assert spark.range(1).select(html.strict_html(F.lit("x<p>"))).first()[0] is None


def test_graph_keeps_linkless_pages_as_nodes(spark):
    anchors = spark.createDataFrame([("http://a.com/", "2013", "http://b.com/x"), ("http://a.com/", "2013", "http://b.com/x/"), ("http://a.com/", "2013", "http://nohost/")], "src_url string, ts14 string, dst_url string")
    edges = graph.links(anchors)
    assert rows(edges, "dst_surt", "dst_url") == [("com,b)/x", "http://b.com/x")]
    sources = spark.createDataFrame([("com,a)/", "http://a.com/"), ("com,z)/", "http://z.com/")], "src_surt string, src_url string")
    nodes = graph.nodes(edges, sources)
    assert rows(nodes, "id", "surt") == [(0, "com,a)/"), (1, "com,b)/x"), (2, "com,z)/")]
    assert rows(graph.adjacency(edges, nodes), "src_id", "dst_ids") == [(0, [1])]
    lines = nodes.select(graph.node_json().alias("value")).unionByName(spark.createDataFrame([('{"id":1}',)], "value string"))
    assert graph.parse_nodes(lines).count() == 3


def test_attachment_walk(spark):
    records = spark.createDataFrame([("f", i, c) for i, c in enumerate("abcde")], "file string, line_no long, checksum string")
    side = spark.createDataFrame([("f", i, x) for i, x in enumerate(["# note", "a 1", "", "x 9", "bad"])], "file string, line_no long, line string")
    want = [(0, "1", "Available"), (1, None, "Unavailable"), (2, "9", "ChecksumMismatch"), (3, "9", "ChecksumMismatch"), (4, "9", "ChecksumMismatch")]
    assert rows(attachments.zipped(records, side), "line_no", "content", "status") == want
    moved = rows(attachments.zipped(records, side, advance_on_mismatch=True), "line_no", "content", "status")
    assert [s for _, _, s in moved] == ["Available", "Unavailable", "ChecksumMismatch", "Malformed", "Unavailable"]
    numbers = attachments.zipped(records, side.withColumn("line", F.regexp_replace("line", "^a 1$", "a one")), parse=int)
    assert rows(numbers, "line_no", "content", "status")[0] == (0, "one", "NotParsable")
    assert attachments.attachment_path("x.cdx.gz", "lang") == "x.cdx.lang.att.gz"


def test_pipe_checks_its_lines(spark):
    df = spark.createDataFrame([("a b",), (None,), ("c",)], "v string")
    assert rows(derive.pipe(df, "v", "tr a-z A-Z"), "piped") == [("",), ("A B",), ("C",)]
    with pytest.raises(Exception, match="of .* lines"):
        derive.pipe(df, "v", "grep a").collect()


def test_plans_have_no_cross_join_and_push_filters(spark):
    from support import SF

    from arcframe.plans import catalog

    plan = catalog.QUERIES["prefix_match"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    scan = joins.key_from(spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name"), "p_name", "m")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_name,m)" in scan and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in scan


def test_long_and_empty_prefixes(spark):
    df = spark.createDataFrame([(0, "k" * 400), (1, "other"), (2, None), (3, "k" * 400)], "i int, w string")
    known = spark.createDataFrame([("k" * 300,), ("k",), ("",), (None,)], "p string")
    assert rows(joins.prefix_match(df, "w", known, "p"), "i", "matched") == [(0, "k" * 300), (1, ""), (2, None), (3, "k" * 300)]
    assert rows(joins.prefix_match(df, "w", known, "p", shortest_wins=True, inner=True), "i", "matched") == [(0, ""), (1, ""), (3, "")]


def test_ranges_carry_their_last_key(spark):
    keys = spark.createDataFrame([(i,) for i in range(10, 1000, 10)] + [(5000,)], "k int")
    asked = spark.createDataFrame([(3,), (10,), (19,), (995,), (4999,), (None,)], "v int")
    assert rows(joins.adjacent(keys, "k", asked, "v"), "k") == [(10,), (990,)]
    parts = layout.equal_parts(spark.range(100).withColumnRenamed("id", "k"), "k", 7).groupBy("part").agg(F.count("k").alias("n"), F.min("k").alias("k"))
    assert rows(parts, "part", "n", "k") == [(0, 15, 0), (1, 15, 15), (2, 14, 30), (3, 14, 44), (4, 14, 58), (5, 14, 72), (6, 14, 86)]
    few = layout.equal_parts(spark.range(3).withColumnRenamed("id", "k"), "k", 7)
    assert rows(few, "k", "part") == [(0, 0), (1, 1), (2, 2)]


def test_index_candidates_in_slices(spark, monkeypatch):
    index = spark.createDataFrame([(i % 2, f"{i:03d}") for i in range(40)], "p int, k string")
    prefixes = spark.createDataFrame([(f"{i:03d}",) for i in range(0, 40, 3)] + [("9",)], "x string")
    want = rows(joins.index_candidates(index, "k", "p", prefixes, "x"), "p", "k", "x")
    monkeypatch.setattr(joins, "BROADCAST_PREFIXES", 3)
    assert rows(joins.index_candidates(index, "k", "p", prefixes, "x"), "p", "k", "x") == want


TARGETS = """<html><head><base href="http://b.com/d/"><style>a{background:url('x.png')} @import "y.css";</style></head><body background="bg.gif">
<p>A paragraph of text that is long enough to count as content.</p><a href="/p">hi <b>there <i>you</i></b> all</a><form action="f"><a href="q">x</a></form>
<applet archive="a.jar,b.jar" codebase="c/"></applet><object data="m.swf"></object><img src="i.png" alt="pic"><link rel="icon" href="no.ico"><link rel="stylesheet" href="s.css">
<script>var a="/q/w.js", b='no url', c='t.html?x', d="k";</script><div style="background:url(z.png)"></div></body></html>"""


def test_targets_labels_and_embeds(spark):
    found = [(x["tag"], x["target"].removeprefix("http://b.com/"), x["label"]) for x in html.page_links(TARGETS, "http://a.com/")]
    files = [("applet", "d/c/a.jar", ""), ("applet", "d/c/b.jar", ""), ("object", "d/m.swf", ""), ("img", "d/i.png", ""), ("link", "d/s.css", "")]
    assert found == [("a", "p", "hi there you all"), ("form", "d/f", ""), ("a", "d/q", "x"), *files]
    embeds = {x.removeprefix("http://b.com/") for x in html.page_embeds(TARGETS, "http://a.com/", scripts=True)}
    assert embeds == {"d/x.png", "d/y.css", "d/bg.gif", "d/c/a.jar", "d/c/b.jar", "d/m.swf", "d/i.png", "d/s.css", "q/w.js", "d/t.html?x", "d/z.png"}
    assert {x.removeprefix("http://b.com/") for x in html.page_embeds(TARGETS, "http://a.com/", content_chars=30)} == {"d/c/a.jar", "d/c/b.jar", "d/m.swf", "d/i.png", "d/z.png"}
    pages = spark.createDataFrame([("http://a.com/", TARGETS)], "url string, html string")
    assert rows(html.labelled(pages, "img", "src", ("alt",)), "target", "label")[0] == ("http://b.com/d/i.png", "pic")
    assert rows(html.selected(pages, ("b", "i")), "name", "text") == [("b", "there you"), ("i", "you")]


def test_short_blocks_are_merged_and_unknown_ones_count(spark):
    text = "the and of\nthat is was with\nto to to to\n" + " ".join(["xx"] * 10) + "\nthe"
    docs = spark.createDataFrame([(1, text)], "k int, t string")
    assert rows(derive.block_languages(docs, "k", "t"), "lang", "share") == [("en", 121 / 221)]


def test_captures_reach_every_page(spark):
    from support import SF

    from arcframe.plans import catalog, tables

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    found = tables.all_captures(spark, SF)
    assert found.count() == pages.count() + events
    assert found.select("url").distinct().count() == pages.select("url").distinct().count()
    lines = catalog.QUERIES["cdx_emit_all_pages"](spark, SF)
    assert lines.count() == pages.count() + events


def test_whole_table_queries_read_every_key(spark):
    from support import SF

    from arcframe.plans import catalog

    orders, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    keys = orders.select(F.col("o_orderkey").alias("key")).union(lines.select("l_orderkey")).distinct().count()
    assert catalog.QUERIES["cogroup_orders_lineitem_whole"](spark, SF).count() == keys


def test_link_queries_resolve_every_kind_of_link(spark, tmp_path):
    from arcframe.plans import catalog

    body = "<html><a href='p.html'>a</a><a href='../x'>b</a><a href='?q'>c</a><a href='//o.org/y'>d</a><area href='/m'><form action='f'></form></html>"
    pages = [(0, "http://a.com/d/e/i.html", body), (1, "http://c.com/", "<html><base href='http://b.net/z/'><a href='w'>e</a></html>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = ["http://a.com/d/e/f", "http://a.com/d/e/i.html?q", "http://a.com/d/e/p.html", "http://a.com/d/x", "http://a.com/m", "http://b.net/z/w", "http://o.org/y"]
    found = sorted(r["target"] for r in catalog.QUERIES["outlinks"](spark, str(tmp_path)).collect())
    assert found == want
    hosts = catalog.QUERIES["host_graph"](spark, str(tmp_path))
    assert rows(hosts, "src_host", "dst_host", "links") == [("a.com", "a.com", 5), ("a.com", "o.org", 1), ("c.com", "b.net", 1)]
    surts = {r["surt"] for r in catalog.QUERIES["link_nodes"](spark, str(tmp_path)).collect()}
    assert {"org,o)/y", "net,b)/z/w", "com,a)/d/x"} <= surts


def test_links_behind_void_tags_and_at_any_depth():
    page = "<p>" + "<br><img src='i.png'>" * 2000 + "<a href='/x'>label</a>" + "<i>" * 3000 + "<a href='/deep'>d<b>e</b></a>"
    found = [(x["target"], x["label"]) for x in html.page_links(page, "http://a.com/") if x["tag"] == "a"]
    assert found == [("http://a.com/x", "label"), ("http://a.com/deep", "d e")]
    void = list(html.iterate_tags("<p><br>one<hr>two</p>"))
    assert [(t["name"], t["closing"], t["stack"]) for t in void] == [("p", False, []), ("br", True, ["p"]), ("hr", True, ["p"]), ("p", True, [])]


def test_handlers_share_one_pass_and_tell_nesting():
    page = "<title>t</title><div id=1><div id=2>x<a href='/a'>A</a></div><div id=3>y</div></div><style>p{}</style><a href='/o'><a href='/i'>in</a> out</a>"
    tags = html.Tags(page)
    title, divs, links, flat, ends = (html.Handler(frozenset(n), *k) for n, k in ((["title"], ()), (["div"], ()), (["a"], ()), (["a"], (False,)), (["div"], (False, True))))
    every = [(h, tags.tags[i].source) for h, i in tags.handle([title, divs, links])]
    assert [s for h, s in every] == ["<title>", "<div id=1>", "<div id=2>", "<a href='/a'>", "<div id=3>", "<a href='/o'>", "<a href='/i'>"]
    names = lambda **k: [tags.tags[i].source for _, i in tags.handle([divs, links], **k)]
    assert names(inner=False) == ["<div id=1>", "<a href='/a'>", "<a href='/o'>"]
    assert names(outer=False) == ["<div id=2>", "<a href='/a'>", "<div id=3>", "<a href='/i'>"]
    assert [tags.tags[i].source for _, i in tags.handle([flat], inner=False)] == ["<a href='/a'>", "<a href='/o'>", "<a href='/i'>"]
    assert [tags.tags[i].source for _, i in tags.handle([ends])].count("</div>") == 3
    first = next(i for _, i in tags.handle([divs]))
    assert tags.text(first) == "x A y" and tags.children(first)[-1].source == "</div>"
    assert html.Tags("<div>a<script>code</script>b</div>").text(0) == "a b"


def test_style_targets_follow_the_grammar():
    found = lambda css: html.css_targets(css, "http://a/b/")
    assert found("x{background:URL( \"p (1).png\" )} y{src:url(q\\)r.png)}") == ["http://a/b/p%20(1).png", "http://a/b/q)r.png"]
    assert found("/* url(no.png) */ a{content:'url(no2.png)'} b{x:url(\\79 es.png)}") == ["http://a/b/yes.png"]
    assert found("@import url(m.css) screen; @import ('n.css') ; @import o.css; @import 'p.css' print;") == ["http://a/b/m.css", "http://a/b/n.css", "http://a/b/o.css"]
    assert found("url()") == [] and found("url(open") == ["http://a/b/open"]


def test_references_end_in_a_semicolon(spark):
    assert html.unescape("a &amp; b &amp &ampc; &copy=1 &notit; &#65; &#x42; &#67 &amp;lt;") == "a & b &amp &ampc; &copy=1 &notit; A B &#67 &lt;"
    page = "<html><head><title>cut &amp; off &amp</title></head><body>one &lt;two&gt; three&amp</body></html>"
    assert html.body_text(page) == "one <two> three&amp"
    found = html.selected(spark.createDataFrame([(1, page)], "page_id int, html string"), ("title",))
    assert [r["text"] for r in found.collect()] == ["cut & off &amp"]
