"""14-digit timestamps (yyyyMMddHHmmss, UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the tail that completes short timestamps.
TAIL = "20000101000000"


def fix(ts: Column) -> Column:
    """Digits only, completed to 14 with the tail of TAIL."""
    digits = F.substring(F.regexp_replace(ts, r"\D", ""), 1, 14)
    return F.concat(digits, F.substring(F.lit(TAIL), F.char_length(digits) + 1, F.lit(14)))


def parse(ts: Column) -> Column:
    """A timestamp, or null where the digits are no date."""
    return F.try_to_timestamp(fix(ts), F.lit("yyyyMMddHHmmss"))


def is_valid(ts: Column) -> Column:
    return parse(ts).isNotNull()


def render(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")
