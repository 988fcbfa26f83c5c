"""URL helpers: decoding, and resolution of links against a page."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arcframe.functions.udf import arrow_udf

ABSOLUTE = re.compile(r"^[a-z]+:", re.IGNORECASE)
KEPT = re.compile(r"^(https?|ftp)://", re.IGNORECASE)


def encode(text: Column) -> Column:
    return F.url_encode(text)


def decode(text: Column) -> Column:
    """URL-decoded; the text itself where it is malformed."""
    return F.coalesce(F.try_url_decode(text), text)


def resolve_one(base: str | None, link: str | None) -> str | None:
    """Absolute http(s) or ftp URL of a link, white space escaped; none for other schemes."""
    if link is None or not (base or ABSOLUTE.match(link.strip())):
        return None
    try:
        found = urljoin(base or "", link.strip())
    except ValueError:
        return None
    if not KEPT.match(found):
        return None
    return found.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D").replace("\t", "%09")


@arrow_udf("string")
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """resolve_one over Arrow batches."""
    return pd.Series([resolve_one(b, x) for b, x in zip(base, link)], dtype=object)
