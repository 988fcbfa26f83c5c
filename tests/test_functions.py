from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from arcframe.functions import digest, surt, text, time14, url


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "key"),
    [
        ("http://www.Example.com/", "com,example)/"),
        ("https://user@Example.com:8080/A/B/?b=2&a=1#frag", "com,example)/a/b?a=1&b=2"),
        ("http://example.com", "com,example)/"),
        ("com,example)/x", "com,example)/x"),
        ("http://example.com/a%20b?x&amp;y", "com,example)/a b?x&y"),
    ],
)
def test_surt(spark, given, key):
    assert one(spark, surt.surt(F.col("u")), u=given) == key


def test_surt_round_trip_and_hosts(spark):
    assert one(spark, surt.surt_to_url(F.col("k")), k="com,example,www)/a?b=1") == "http://www.example.com/a?b=1"
    assert one(spark, surt.surt_host(F.col("k")), k="com,example:80)/a") == "com,example"
    for host, sound in (("com,example", True), ("com", False), ("com,,x", False), ("com,-x", False), ("com,x--y", False), ("com,x-y", True)):
        assert one(spark, surt.is_valid_host(F.col("h")), h=host) is sound, host
    prefixes = one(spark, surt.url_prefixes(F.col("u")), u="http://example.com/a")
    assert set(prefixes) == {f"com,example{port})/a{end}" for port in ("", ":80", ":443") for end in (" ", "?", "#", "/")}
    assert set(one(spark, surt.url_prefixes(F.col("u")), u="example.com")) == {"com,example)", "com,example:80)", "com,example:443)", "com,example,"}
    assert set(one(spark, surt.url_prefixes(F.col("u")), u="http://example.com/a/?b=1")) == {f"com,example{port})/a?b=1 " for port in ("", ":80", ":443")} | set()
    assert one(spark, surt.surt_to_url(F.col("k")), k="https://x.org/a") == "https://x.org/a"
    assert one(spark, surt.surt_from_base(F.col("a"), F.col("b")), a="../c?z&y", b="com,example)/a/b/") == "com,example)/a/c?y&z"


def test_time14(spark):
    assert one(spark, time14.fix(F.col("t")), t="2013") == "20130101000000"
    assert one(spark, time14.fix(F.col("t")), t="") == "20000101000000"
    assert one(spark, time14.is_valid(F.col("t")), t="20131301") is False
    assert str(one(spark, time14.parse(F.col("t")), t="20131231235959")) == "2013-12-31 23:59:59"


def test_text(spark):
    assert one(spark, text.tokenize(F.col("t")), t="") == [""]
    assert one(spark, text.tokenize(F.col("t")), t="Ab-c, É1!") == ["ab", "c", "é1"]
    assert one(spark, text.trim_lines(F.col("t")), t=" a \n b\n\n\n c ") == "a\nb\n\nc"
    assert one(spark, text.strip_bracket(F.col("t"), "(", ")"), t="(a)") == "a"
    assert one(spark, text.pad_left(F.col("t"), 3, "0"), t="12345") == "12345"
    assert one(spark, text.format_bytes(F.col("n")), n=1024) == "1024 bytes"
    assert one(spark, text.format_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, text.thousands(F.col("n"), 2), n=1234.05) == "1,234.05"
    assert one(spark, text.after(F.col("t"), "="), t="none") == "none"
    assert one(spark, text.split_limited(F.col("t"), ",", 2), t="a,") == ["a", ""]
    assert one(spark, text.split_limited(F.col("t"), ",", 3), t="a,") == ["a"]
    assert one(spark, text.split_limited(F.col("t"), ",", 2), t="") == [""]
    assert one(spark, text.strip_bracket(F.col("t"), "'", "'"), t="'") == ""
    assert one(spark, text.strip_bracket(F.col("t"), "<B>", "</b>"), t="<b>x</B>") == "x"
    assert one(spark, text.has_word_character(F.col("t")), t="12") is False
    assert one(spark, text.is_absolute_url_start(F.col("t")), t="//a") is False
    assert one(spark, text.clean_latin(F.col("t")), t="a: b\u0301 & " + "x" * 100 + " c;") == "a b & c;"
    nested = spark.createDataFrame([(0, "((((((((((((x))))))))))))"), (1, "y"), (2, None)], "i int, t string")
    assert sorted(tuple(r) for r in text.to_fixpoint(nested, "t", lambda t: text.strip_bracket(t, "(", ")")).collect()) == [(0, "x"), (1, "y"), (2, None)]
    assert one(spark, text.clean_latin(F.col("t")), t="ab 漢字 é!") == "ab é!"


def test_digests(spark):
    want = base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()
    assert one(spark, digest.sha1_base32(F.col("t")), t="é") == want
    assert one(spark, digest.little_endian(F.unhex(F.col("t"))), t="01000000") == 1
    assert one(spark, digest.big_endian(F.unhex(F.col("t"))), t="00000100") == 256


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        ("http://a.com/x/y", "z", "http://a.com/x/z"),
        ("http://a.com/x/y", "/z q", "http://a.com/z%20q"),
        ("http://a.com/x/y", "//b.org/q", "http://b.org/q"),
        ("http://a.com/x/y", "mailto:x@y", None),
        ("http://a.com/x/y", "javascript:1", None),
        (None, "z", None),
    ],
)
def test_resolve(base, link, want):
    assert url.resolve_one(base, link) == want
