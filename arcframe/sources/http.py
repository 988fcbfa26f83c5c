"""HTTP messages inside record payloads."""

from __future__ import annotations

import gzip
import re
import zlib

import pandas as pd

from arcframe.functions import charsets
from arcframe.functions.udf import arrow_udf

MESSAGE = "struct<status_line:string, status:int, headers:map<string,string>, mime:string, charset:string, location:string, body:binary, body_string:string, error:string>"
FIELDS = ("status_line", "status", "headers", "mime", "charset", "location", "body", "body_string", "error")
# Charsets tried in turn after the header's own.
CHARSETS = ("utf-8", "iso-8859-1", "windows-1252")

MARKUP = ("text/html", "application/xhtml+xml", "text/xml", "application/xml")


def dechunk(body: bytes) -> bytes:
    """The chunks of a chunked body; a malformed rest is kept as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = re.match(rb"\s*([0-9A-Fa-f]+)", body[at:end])
        if not size:
            return b"".join(out) + body[at:] if out else body
        n = int(size[1], 16)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def decoded(body: bytes, encoding: str) -> bytes:
    """The content codings undone, last first; 'deflate' with or without a zlib header."""
    for name in reversed([e.strip().lower() for e in encoding.split(",") if e.strip()]):
        if name in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif name == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
        elif name == "br":
            import brotli

            body = brotli.decompress(body)
    return body


def text(body: bytes, charset: str | None, markup: bool = False) -> str:
    """Text by the header's charset, or by the first of CHARSETS, that decodes strictly.

    Markup whose header names no charset, or a wrong one, is read by the charsets that it
    declares itself, line by line.
    """
    try:
        if charset:
            return body.decode(charset)
    except (LookupError, UnicodeError):
        pass
    if markup:
        return "\n".join(charsets.text_lines(body, CHARSETS[:1], CHARSETS[1:]))
    for name in CHARSETS:
        try:
            return body.decode(name)
        except UnicodeError:
            continue
    return body.decode("utf-8", "replace")


def message(payload: bytes) -> tuple | None:
    """Fields of an HTTP message, or None where there is no status or request line."""
    payload = payload.lstrip(b"\r\n")
    head, _, body = payload.partition(b"\r\n\r\n") if b"\r\n\r\n" in payload else payload.partition(b"\n\n")
    lines = head.decode("iso-8859-1").splitlines()
    if not lines or not (lines[0].startswith("HTTP/") or re.search(r"HTTP/[\d.]+$", lines[0].strip())):
        return None
    headers = {k.strip().lower(): v.strip() for k, sep, v in (line.partition(":") for line in lines[1:]) if sep}
    status = re.match(r"HTTP/\S+\s+(\d{3})", lines[0])
    kind = headers.get("content-type", "")
    mime = kind.split(";")[0].strip().lower() or None
    charset = re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", kind, re.IGNORECASE)
    error = None
    try:
        if "chunked" in headers.get("transfer-encoding", "").lower():
            body = dechunk(body)
        body = decoded(body, headers.get("content-encoding", ""))
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
    name = charset[1] if charset else None
    return lines[0], int(status[1]) if status else None, headers, mime, name, headers.get("location"), body, text(body, name, mime in MARKUP), error


@arrow_udf(MESSAGE)
def parsed(payloads: pd.Series) -> pd.DataFrame:
    rows = [message(bytes(p)) if p is not None else None for p in payloads]
    return pd.DataFrame([r if r is not None else (None,) * len(FIELDS) for r in rows], columns=FIELDS).astype({"status": "Int32"})
