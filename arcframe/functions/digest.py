"""Digests and byte decoding as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arcframe.functions.udf import arrow_udf

# Fixed value: the RFC 4648 base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(value: Column) -> Column:
    """SHA-1 in upper-case base32 (32 characters): eight groups of 20 bits, four letters each.

    The digest is bound once, as the element of an array, and stands once in the plan.
    """

    def spelled(hexed: Column) -> Column:
        letters = []
        for group in range(8):
            number = F.conv(F.substring(hexed, F.lit(5 * group + 1), F.lit(5)), 16, 10).cast("int")
            for shift in (15, 10, 5, 0):
                letters.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
        return F.concat(*letters)

    return F.transform(F.array(F.sha1(value.cast("binary"))), spelled)[0]


def md5_hex(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def sha1_hex(value: Column) -> Column:
    return F.sha1(value.cast("binary"))


def little_endian(value: Column) -> Column:
    """Bytes, lowest first, as a number."""
    pairs = F.regexp_extract_all(F.hex(value), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def big_endian(value: Column) -> Column:
    return F.conv(F.hex(value), 16, 10).cast("long")


@arrow_udf("int")
def string_hash(text: pd.Series) -> pd.Series:
    """The 32-bit string hash: units of UTF-16, each time 31 times what was there."""

    def one(x: str | None) -> int | None:
        if x is None:
            return None
        h = 0
        for unit in np.frombuffer(x.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
            h = (31 * h + unit) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    return text.map(one).astype("Int32")
