"""Bytes as text: codecs of content, and text whose charset is declared on the way."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column

from arcframe.functions.udf import arrow_udf

_DECLARED = re.compile(r"""(?:encoding|charset)\s*=["'\s]*([^"'\s<>;/?]+)""")
# File endings and first bytes by codec.
ENDINGS = {".gz": "gzip", ".tgz": "gzip", ".zst": "zstd"}
MAGICS = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd"}


def text_lines(body: bytes, charsets: Sequence[str], last: Sequence[str] = ()) -> Iterator[str]:
    """The lines of a body, each by the first charset that decodes it strictly.

    A charset that a line declares, in markup or an XML head, comes first from the next line
    on; those of `last` are tried behind all of them. What no charset decodes is read by the
    first known one without its bad bytes.
    """
    known = list(dict.fromkeys(charsets))
    for line in body.split(b"\n"):
        text = None
        for name in (*known, *last):
            try:
                text = line.decode(name)
                break
            except (LookupError, UnicodeError):
                continue
        if text is None:
            text = line.decode(next((c for c in known if _exists(c)), "utf-8"), "ignore")
        yield text
        new = [c for c in dict.fromkeys(_DECLARED.findall(text)) if c not in known]
        known = [*new, *known]


def _exists(charset: str) -> bool:
    try:
        "".encode(charset)
        return True
    except LookupError:
        return False


def adaptive_text(body: bytes | None, charsets: Sequence[str] = ("utf-8",)) -> str | None:
    """A body's text_lines(), joined by line feeds; one at its end is left out. Null gives null."""
    return None if body is None else "\n".join(text_lines(body.removesuffix(b"\n"), charsets))


def adaptive(body: Column, charsets: Sequence[str] = ("utf-8",)) -> Column:
    @arrow_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: adaptive_text(None if b is None else bytes(b), charsets))

    return run(body)


def codec(name: str | None, head: bytes) -> str | None:
    """gzip, zstd or None: by the file's ending, else by its first bytes."""
    by_name = next((kind for end, kind in ENDINGS.items() if (name or "").lower().endswith(end)), None)
    return by_name or next((kind for magic, kind in MAGICS.items() if head.startswith(magic)), None)


def unpacked(content: bytes, name: str | None = None) -> bytes:
    """Content without its codec, all members or frames of it; plain content as it is."""
    kind = codec(name, content[:4])
    if kind == "gzip":
        return gzip.decompress(content)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    return content


@arrow_udf("binary")
def unpack(contents: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else unpacked(bytes(c), n) for c, n in zip(contents, names)], dtype=object)
