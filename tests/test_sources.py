from __future__ import annotations

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from arcframe.sources import http, indexed, jobs, lines, warc


def response(url, body, extra=b""):
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + extra + b"\r\n" + body
    return warc.record_bytes("WARC/1.0", [("WARC-Type", "response"), ("WARC-Target-URI", url), ("WARC-Date", "2013-01-02T03:04:05Z")], message)


def test_gzip_members_survive_damage(spark, tmp_path):
    good = [warc.zlib_member(response(f"http://a.com/{i}", b"<p>%d</p>" % i)) for i in range(3)]
    bad = bytearray(good[1])
    bad[len(bad) // 2] ^= 0xFF
    (tmp_path / "x.warc.gz").write_bytes(good[0] + bytes(bad) + good[2])
    warc.register(spark)
    found = warc.with_fields(spark.read.format("warc").load(str(tmp_path / "*.warc.gz")))
    got = sorted((r["url"], r["offset"], r["length"], r["ts14"]) for r in found.collect())
    assert got == [("http://a.com/0", 0, len(good[0]), "20130102030405"), ("http://a.com/2", len(good[0]) + len(bad), len(good[2]), "20130102030405")]
    table = warc.to_cdx(spark.read.format("warc").load(str(tmp_path / "*.warc.gz"))).orderBy("surt").collect()
    assert [(r["surt"], r["mime"], r["status"], r["extra"][0]) for r in table][0] == ("com,a)/0", "text/html", 200, "0")


def test_plain_warc_arc_and_zstd(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    body = response("http://a.com/", b"hello")
    (tmp_path / "a.warc").write_bytes(body + body)
    one = b"http://b.com/ 1.2.3.4 20130102030405 text/html 5\nhello\n"
    two = b"http://c.com/ 1.2.3.4 20130102030405 text/html 200 abc - 0 f.arc 5\nworld\n"
    (tmp_path / "b.arc").write_bytes(b"filedesc://x 0.0.0.0 20130101 text/plain 3\n1 1\n" + one + two)
    (tmp_path / "c.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(body) * 2)
    warc.register(spark)
    for name, urls in (("a.warc", ["http://a.com/"] * 2), ("b.arc", ["http://b.com/", "http://c.com/"]), ("c.warc.zst", ["http://a.com/"] * 2)):
        found = warc.with_fields(spark.read.format("warc").load(str(tmp_path / name))).collect()
        assert [r["url"] for r in found] == urls, name
    raw = spark.read.format("warc").option("mode", "raw").load(str(tmp_path / "c.warc.zst")).collect()
    assert bytes(raw[1]["payload"])[:4] == warc.ZSTD


def test_written_archive_reads_back(spark, tmp_path):
    warc.register(spark)
    rows = [("WARC/1.0", [("WARC-Type", "resource"), ("WARC-Target-URI", f"http://a/{i}")], b"x" * i) for i in range(20)]
    df = spark.createDataFrame(rows, "version string, headers array<struct<k:string,v:string>>, payload binary")
    df = df.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), "version", "headers", "payload")
    df.repartition(3).write.format("warc").mode("append").save(str(tmp_path / "out"))
    back = warc.with_fields(spark.read.format("warc").load(str(tmp_path / "out/*.warc.gz"))).select("url", F.octet_length("payload").alias("n"))
    assert sorted(map(tuple, back.collect())) == sorted((f"http://a/{i}", i) for i in range(20))


def test_members_fall_into_the_range_they_start_in(spark, tmp_path):
    body = b"".join(warc.zlib_member(response(f"http://a.com/{i}", bytes(i % 251 for _ in range(200 + i)))) for i in range(300))
    (tmp_path / "m.warc.gz").write_bytes(body)
    warc.register(spark)
    path = str(tmp_path / "m.warc.gz")
    cut = spark.read.format("warc").option("splitBytes", 1000).load(path)
    assert cut.rdd.getNumPartitions() == -(-len(body) // 1000)
    found = sorted((r["offset"], r["length"]) for r in cut.select("offset", "length").collect())
    assert found == sorted((r["offset"], r["length"]) for r in spark.read.format("warc").load(path).collect()) and len(found) == 300
    wanted = cut.where("offset % 7 = 0").select("file", "offset", "length")
    got = warc.with_fields(warc.extract(wanted)).select("offset", "url", "type").collect()
    assert len(got) == wanted.count() and {r["type"] for r in got} == {"response"}


def test_plain_records_larger_than_a_chunk(spark, tmp_path):
    big = response("http://a.com/big", b"x" * (3 << 20))
    (tmp_path / "a.warc").write_bytes(big + response("http://a.com/2", b"y"))
    warc.register(spark)
    found = warc.with_fields(spark.read.format("warc").load(str(tmp_path))).select("url", F.octet_length("payload").alias("n"), "length").collect()
    assert [r["url"] for r in found] == ["http://a.com/big", "http://a.com/2"] and found[0]["length"] == len(big) - 4


def test_arc_fields(spark, tmp_path):
    two = b"http://c.com/ 1.2.3.4 20130102030405 text/html 302 abc http://d.com/ 77 f.arc 5\nworld\n"
    (tmp_path / "b.arc").write_bytes(two)
    warc.register(spark)
    found = dict((h["k"], h["v"]) for h in spark.read.format("warc").load(str(tmp_path / "b.arc")).first()["headers"])
    assert (found["ARC-Result-Code"], found["ARC-Location"], found["ARC-Record-Location"], found["WARC-Payload-Digest"]) == ("302", "http://d.com/", "77", "abc")


def test_an_index_scan_reads_few_blocks(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    path = str(tmp_path / "ix")
    indexed.write_indexed(rows, path, block_lines=100)
    index = indexed.read_index(spark, path)
    assert index.agg(F.sum("lines")).first()[0] == 20_000
    one = spark.createDataFrame([("k0001",), ("k01234",)], "prefix string")
    blocks = indexed.blocks_of_prefixes(index, one)
    assert 2 <= blocks.count() <= 6
    found = indexed.scan(spark, path, one)
    assert found.count() == 110 and {r[0] for r in found.select("matched").distinct().collect()} == {"k0001", "k01234"}
    asked = spark.createDataFrame([("k000000",), ("k000100",), ("k019999",), ("nothing",), (None,)], "key string")
    assert sorted((r["key"], r["line"]) for r in indexed.lookup(spark, path, asked).collect()) == [("k000000", "line 0"), ("k000100", "line 100"), ("k019999", "line 19999"), ("nothing", None)]


def test_lookup_of_a_key_over_many_blocks(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"{k}{i}") for k in "abc" for i in range(25)], "key string, line string")
    indexed.write_indexed(rows, str(tmp_path / "ix"), block_lines=4, parts=2)
    found = indexed.lookup(spark, str(tmp_path / "ix"), spark.createDataFrame([("b",)], "key string"))
    assert sorted(r["line"] for r in found.collect()) == sorted(f"b{i}" for i in range(25))


def test_http_bodies():
    body = gzip.compress("é".encode("iso-8859-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    found = dict(zip(http.FIELDS, http.message(b"\r\nHTTP/1.1 301 Moved\r\nLocation: /x\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked)))
    assert (found["status"], found["location"], found["body_string"], found["error"]) == (301, "/x", "é", None)
    assert http.decoded(zlib.compress(b"x"), "deflate") == b"x" == http.decoded(zlib.compress(b"x")[2:-4], "deflate")
    assert http.message(b"not http") is None
    assert http.message(b"HTTP/1.0 200 OK\r\nContent-Encoding: gzip\r\n\r\nbroken")[-1]


def test_lines_and_names(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"1\r\n2\n3\n")
    (tmp_path / "in/b.txt").write_bytes(b"4\n")
    got = sorted((r["file"][-5:], r["line_no"], r["line"], r["chunk"]) for r in lines.chunks_of_lines(spark, str(tmp_path / "in"), 2).collect())
    assert got == [("a.txt", 0, "1", 0), ("a.txt", 1, "2", 0), ("a.txt", 2, "3", 1), ("b.txt", 0, "4", 0)]
    assert lines.read_lines(spark, str(tmp_path / "in")).count() == 4
    df = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "n string, v string")
    lines.save_named(df, "n", "v", str(tmp_path / "named"), 2)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "named/name=x")).collect()) == ["1", "3"]
    index = lines.line_index(df.withColumn("p", F.lit(0)), "n", "v", "p")
    assert sorted((r["n"], r["count"], r["offset"], r["length"]) for r in index.collect()) == [("x", 2, 0, 4), ("y", 1, 4, 2)]


def test_jobs(spark, tmp_path):
    made = jobs.keyed_checkpoint(spark.range(5), "five", str(tmp_path))
    assert jobs.keyed_checkpoint(spark.range(9), "five", str(tmp_path)).count() == made.count() == 5
    out = jobs.loop(spark.range(1), lambda d: d.select((F.col("id") + 1).alias("id")), lambda _, a: a.first()[0] >= 3, 10)
    assert out.first()[0] == 3


def test_stream_counts_every_event(spark, tmp_path):
    from support import SF

    from arcframe.streaming import captures

    counts = captures.windowed_counts(captures.read_events(spark, SF), "1 day")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_files_are_read_once(tmp_path):
    import gzip

    from arcframe.sources import ranges, warc

    record = lambda i: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\n" + bytes([65 + i % 26]) * 900 + b"\r\n\r\n"
    plain, packed = tmp_path / "a.warc", tmp_path / "a.warc.gz"
    plain.write_bytes(b"".join(record(i) for i in range(3000)))
    packed.write_bytes(b"".join(gzip.compress(record(i)) for i in range(3000)))
    for path, read in ((plain, warc.plain_records), (packed, warc.gzip_members)):
        f = ranges.Ranged(str(path))
        assert sum(1 for _ in read(f)) == 3000
        assert f.fetched < 1.2 * path.stat().st_size + (1 << 20)
        f.close()
    small = ranges.Ranged(str(packed))
    assert small.find(b"\x1f\x8b", 1, small.size) == len(gzip.compress(record(0))) and small.find(b"not there", 0, small.size) == -1


def test_pointers_into_zstd_files_give_their_records(spark, tmp_path):
    import zstandard

    from arcframe.sources import warc

    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/{i}\r\nContent-Length: 3\r\n\r\nb{i:02d}\r\n\r\n".encode()
    dictionary = zstandard.ZstdCompressionDict(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/" * 20)
    raw = dictionary.as_bytes()
    frames = [zstandard.ZstdCompressor(dict_data=dictionary).compress(record(i)) for i in range(20)]
    (tmp_path / "a.warc.zst").write_bytes(b"\x5d\x2a\x4d\x18" + len(raw).to_bytes(4, "little") + raw + b"".join(frames))
    (tmp_path / "b.warc.zst").write_bytes(b"".join(zstandard.compress(record(i)) for i in range(20, 25)))
    warc.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path))
    pointers = rows.select("file", "offset", "length")
    found = warc.extract(pointers)
    assert sorted(bytes(r["payload"]) for r in found.collect()) == [b"b%02d" % i for i in range(25)]
    import pytest

    with pytest.raises(Exception, match="no record in"):
        warc.extract(spark.createDataFrame([(str(tmp_path / "b.warc.zst"), 3, 9)], "file string, offset long, length long")).count()
