"""CDX capture lines: parsing, writing and index operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcframe.functions import digest, surt, time14
from arcframe.operators.groups import first_per_key
from arcframe.operators.joins import prefix_match

FIELDS = ("surt", "ts14", "url", "mime", "status", "digest", "redirect", "meta", "compressed_size")


def parse(lines: DataFrame, column: str = "value", *kept: str) -> DataFrame:
    """CDX columns of text lines, and the columns kept; lines of fewer than seven or of exactly eight fields go.

    Seven fields are the server layout (no redirect and meta); nine or more are the full
    one with extras. A bad status is -1; lines with a bad size go.
    """
    f = F.col("__fields")
    n = F.size(f)
    lines = lines.select(*kept, F.explode(F.array(F.split(F.col(column), "[ \\t]"))).alias("__fields"))  # a generator is not copied into each field
    server = n == 7
    at = lambda i: F.get(f, F.lit(i))
    size = F.when(server, at(6)).otherwise(at(8))
    size = F.when(size == "-", F.lit("0")).otherwise(size).try_cast("long")
    out = lines.where((n == 7) | (n >= 9)).select(
        *kept,
        at(0).alias("surt"),
        F.substring(F.regexp_replace(at(1), r"\D", ""), 1, 14).alias("ts14"),
        at(2).alias("url"),
        at(3).alias("mime"),
        F.coalesce(at(4).try_cast("int"), F.lit(-1)).alias("status"),
        at(5).alias("digest"),
        F.when(server, "-").otherwise(at(6)).alias("redirect"),
        F.when(server, "-").otherwise(at(7)).alias("meta"),
        size.alias("compressed_size"),
        F.when(n > 9, F.slice(f, 10, F.greatest(n - 9, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("extra"),
    )
    return out.where("compressed_size is not null")


def line() -> Column:
    """The text of a CDX row."""
    status = F.when(F.col("status") < 0, "-").otherwise(F.col("status").cast("string"))
    head = F.concat_ws(" ", "surt", "ts14", "url", "mime", status, "digest", F.regexp_replace("redirect", r"\s", "%20"), "meta", F.col("compressed_size").cast("string"))
    return F.when(F.size("extra") > 0, F.concat(head, F.lit(" "), F.array_join("extra", " "))).otherwise(head)


def location() -> Column:
    """struct(file, offset) from the extras: the last number but the final extra, the rest is the file."""
    n = F.size("extra")
    return F.when(n >= 2, F.struct(F.element_at("extra", -1).alias("file"), F.element_at("extra", -2).try_cast("long").alias("offset")))


def time() -> Column:
    return time14.parse(F.col("ts14"))


def body_keys(bodies: DataFrame) -> DataFrame:
    """(url, body) rows with surt, digest and compressed_size in place of the body."""
    body = F.coalesce(F.col("body"), F.lit(""))
    own = (surt.surt(F.col("url")).alias("surt"), digest.sha1_base32(body).alias("digest"), F.octet_length(body).cast("long").alias("compressed_size"))
    return bodies.select("*", *own).drop("body")


def from_captures(captures: DataFrame) -> DataFrame:
    """CDX columns of (url, ts14, mime, status, body), or of rows with body_keys() in place of the body.

    Many captures of one body should be joined to its keys: they are worked out once a body.
    """
    keyed = body_keys(captures) if "body" in captures.columns else captures
    return keyed.select(
        "surt",
        time14.fix(F.col("ts14")).alias("ts14"),
        "url",
        F.coalesce("mime", F.lit("-")).alias("mime"),
        F.coalesce("status", F.lit(-1)).alias("status"),
        "digest",
        F.lit("-").alias("redirect"),
        F.lit("-").alias("meta"),
        "compressed_size",
        F.array().cast("array<string>").alias("extra"),
    )


def html_pages(cdx: DataFrame) -> DataFrame:
    return cdx.where((F.col("status") == 200) & (F.col("mime") == "text/html"))


def latest(cdx: DataFrame) -> DataFrame:
    """The last capture of each key."""
    return first_per_key(cdx, ["surt"], [-F.col("ts14").cast("long"), F.col("digest")])


def first_of_digest(cdx: DataFrame) -> DataFrame:
    """The first capture of each (key, digest): what a revisit would refer to."""
    return first_per_key(cdx, ["surt", "digest"], [F.col("ts14"), F.col("url")])


def scan(cdx: DataFrame, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Captures whose key begins with a prefix, with the longest one as `matched`."""
    return prefix_match(cdx, "surt", prefixes, prefix, inner=True)
