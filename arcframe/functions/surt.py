"""SURT (reversed-host) URL keys as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcframe.functions.text import after, before, is_absolute_url_start
from arcframe.functions.url import resolve

# Fixed value: hosts of a valid key.
HOST_PATTERN = r"^[a-z]+,[\p{L}\p{M}0-9\-,]+$"


def url_host(url: Column) -> Column:
    """Lower-case host without user and port."""
    rest = F.regexp_replace(url, r"^(?i)[a-z][a-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ",")


def _decoded(url: Column) -> Column:
    plain = reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")), url)
    return F.coalesce(F.try_url_decode(plain), plain)


def surt(url: Column) -> Column:
    """Reversed host, ')', then path and sorted query, lower-cased; fragment, user and port go.

    A text that has ')' before its first '/' is a key already and stays as it is.
    """
    close, slash = F.locate(")", url), F.locate("/", url)
    is_key = (close > 0) & ((slash == 0) | (close < slash))
    plain = F.regexp_replace(_decoded(F.trim(url)), r"#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(plain, r"^(?i)[a-z][a-z0-9+.\-]*://", ""), r"^[^/?]*", "")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"(?<=.)/$", "")
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    key = F.concat(reversed_host(url_host(plain)), F.lit(")"), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))
    return F.when(is_key, url).otherwise(F.lower(key))


def surt_host(key: Column) -> Column:
    """Reversed host of a key, without ')' and port."""
    head = before(key, "/")
    return F.regexp_replace(F.regexp_replace(head, r"\)$", ""), r":\d+$", "")


def surt_to_url(key: Column) -> Column:
    """http URL of a key; what is a URL already stays."""
    host = F.array_join(F.reverse(F.split(F.regexp_replace(before(key, ")"), ",$", ""), ",")), ".")
    url = F.concat(F.lit("http://"), host, F.when(F.locate(")", key) > 0, after(key, ")")).otherwise(""))
    return F.when(is_absolute_url_start(key), key).otherwise(url)


def surt_from_base(link: Column, base: Column) -> Column:
    """Key of a link that is resolved against a base, a URL or key."""
    return surt(resolve(surt_to_url(base), link))


def is_valid_host(host: Column) -> Column:
    """Two labels or more, none empty or with '-' at an edge, no '--'."""
    labels = F.split(host, ",")
    sound = F.forall(labels, lambda x: (x != "") & ~x.startswith("-") & ~x.endswith("-"))
    return host.rlike(HOST_PATTERN) & ~host.contains("--") & sound


def url_prefixes(url: Column, subdomains: bool = True, subpaths: bool = True) -> Column:
    """Key prefixes that cover a URL.

    With a path: the site's key with each default port, the path and each delimiter that can
    follow it (only the end of the key where the path has a query). Without one: the site
    with each port and, on demand, its subdomains. A site with a port has that port only.
    """
    key = surt(F.when(is_absolute_url_start(url), url).otherwise(F.concat(F.lit("http://"), url)))
    site, path = F.trim(before(key, ")")), F.when(F.locate(")", key) > 0, F.trim(after(key, ")"))).otherwise("")
    path = F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", "")
    ports = F.when(site.contains(":"), F.array(F.lit(""))).otherwise(F.array(*[F.lit(p) for p in ("", ":80", ":443")]))
    ends = [" ", "?", "#", "/" if subpaths else "/ "]
    own = F.when(path.contains("?") | path.contains("#"), F.array(F.lit(" "))).otherwise(F.array(*[F.lit(e) for e in ends]))
    whole = F.flatten(F.transform(ports, lambda p: F.transform(own, lambda e: F.concat(site, p, F.lit(")/"), path, e))))
    bare = F.transform(ports, lambda p: F.concat(site, p, F.lit(")")))
    if subdomains:
        bare = F.when(site.contains(":"), bare).otherwise(F.concat(bare, F.array(F.concat(site, F.lit(",")))))
    return F.when(site == "", F.array().cast("array<string>")).otherwise(F.when(path == "", bare).otherwise(whole))
