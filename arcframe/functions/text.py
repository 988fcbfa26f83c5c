"""String functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcframe.session import stored

# Characters of a word that is dropped, and byte units, 1024 apart.
LONG_WORD = 100
UNITS = ("bytes", "KB", "MB", "GB", "TB", "PB")


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; an empty text gives one empty token."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}0-9]+", " ")), " ")


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def trim_lines(text: Column) -> Column:
    """White space collapsed; one newline stays one, two or more become two."""
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{2,}", "\n\n"), r"^\s+|\s+$", "")


def remove_long_words(text: Column, longest: int) -> Column:
    """Runs of longest or more non-space characters are dropped."""
    return F.regexp_replace(text, rf"\S{{{longest},}}", "")


def clean_latin(text: Column) -> Column:
    """Latin letters, digits and common punctuation stay, all else becomes a space; long words go."""
    return trim_lines(F.regexp_replace(remove_long_words(text, LONG_WORD), r"[^\p{IsLatin}0-9\s.,!?'\"()\-&;]+", " "))


def strip_prefix(text: Column, prefix: str) -> Column:
    """text without the prefix, whatever its case."""
    cut = F.lower(F.substring(text, 1, len(prefix))) == prefix.lower()
    return F.when(cut, F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    """text without the suffix, whatever its case."""
    n = len(suffix)
    cut = (F.lower(F.right(text, F.lit(n))) == suffix.lower()) & (F.char_length(text) >= n)
    return F.when(cut, F.left(text, F.char_length(text) - n)).otherwise(text)


def strip_bracket(text: Column, left: str, right: str) -> Column:
    """text without one pair of brackets around it, whatever their case; one mark can be both."""
    low = F.lower(text)
    both = low.startswith(left.lower()) & low.endswith(right.lower())
    inner = F.substring(text, F.lit(len(left) + 1), F.greatest(F.char_length(text) - len(left) - len(right), F.lit(0)))
    return F.when(both, inner).otherwise(text)


def before(text: Column, separator: str) -> Column:
    """What stands before the first separator; the whole text without one."""
    return F.substring_index(text, separator, 1)


def after(text: Column, separator: str) -> Column:
    """What stands behind the first separator; the whole text without one."""
    at = F.locate(separator, text)
    return F.when(at > 0, F.substring(text, at + len(separator), F.char_length(text))).otherwise(text)


def pad_left(text: Column, width: int, fill: str = " ") -> Column:
    """Pads and never cuts."""
    return F.lpad(text, F.greatest(F.char_length(text), F.lit(width)), F.lit(fill))


def pad_right(text: Column, width: int, fill: str = " ") -> Column:
    return F.rpad(text, F.greatest(F.char_length(text), F.lit(width)), F.lit(fill))


def pad_number(number: Column, width: int) -> Column:
    return pad_left(number.cast("string"), width, "0")


def thousands(number: Column, places: int = 0) -> Column:
    """Thousands separators and a zero-padded fraction."""
    return F.format_number(number, places)


def format_bytes(size: Column) -> Column:
    """The largest unit of which there is more than one, with one decimal."""
    out = F.concat(size.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(UNITS[1:], 1):
        scaled = size / F.lit(float(1024**power))
        out = F.when(size > 1024**power, F.concat(F.format_string("%.1f", scaled), F.lit(f" {unit}"))).otherwise(out)
    return out


def is_absolute_url_start(text: Column) -> Column:
    return F.lower(text).rlike(r"\A[a-z]+:.*\z")


def has_word_character(text: Column) -> Column:
    """Whether there is a letter or mark; digits are none."""
    return text.rlike(r"[\p{L}\p{M}]")


def split_limited(text: Column, pattern: str, limit: int) -> Column:
    """At most limit parts; an empty last part is dropped where there are fewer."""
    parts = F.split(text, pattern, limit)
    cut = (F.element_at(parts, -1) == "") & (F.size(parts) < limit) & (text != "")
    return F.when(cut, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def to_fixpoint(df: DataFrame, column: str, step) -> DataFrame:
    """df with step applied to the column until no value changes, however often that takes.

    Each round is written to the shared folder; only rows that still change take part in it.
    """
    done, rest = [], df.withColumn("__before", F.lit(None).cast("string"))
    while True:
        rest = stored(rest.withColumn("__before", F.col(column)).withColumn(column, step(F.col(column))), "fixpoint")
        moved = ~F.col(column).eqNullSafe(F.col("__before"))
        done.append(rest.where(~moved).drop("__before"))
        rest = rest.where(moved)
        if rest.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), done)
