"""Forced-boundary splitting of texts for BPE.

A merge joins two byte strings into a vocabulary token, so a pair of bytes that occurs
inside no token is never merged across: a certain cut. Cuts are taken where such a pair
ends in ASCII white space and does not begin with it, or leads from an ASCII letter to
ASCII punctuation. There both tokenizers' word patterns also begin a new word whatever
stands to the left, so fragments can be encoded one by one and their ids concatenated.
Apostrophes (contractions) and the signs of special tokens are left out of the second kind.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from arcframe.llm.common import HEAD

WHITE = b" \t\n\r\x0b\x0c"
#: Bytes of text whose fragments are held at once.
SLICE_BYTES = 2 << 20
LETTERS = bytes([*range(65, 91), *range(97, 123)])
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Fragments in the younger half of a worker's memory.
MEMO_ROWS = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: each byte's character -> the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> dict[int, bytes]:
    """Bytes of each id of a byte-level vocabulary file, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, suffix = byte_alphabet(), spec["model"].get("end_of_word_suffix") or ""
    out = {}
    for token, i in spec["model"]["vocab"].items():
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
        out[i] = bytes(alphabet[c] for c in body)
    for added in spec["added_tokens"]:
        out[added["id"]] = added["content"].encode()
    return out


def forced_cuts(path: str) -> np.ndarray:
    """cut[a, b]: the byte pair (a, b) lies in no token and begins a word (see above)."""
    inside = np.zeros((256, 256), bool)
    for body in token_bytes(path).values():
        codes = np.frombuffer(body, np.uint8)
        inside[codes[:-1], codes[1:]] = True
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    starts = white[None, :] & ~white[:, None]
    starts[np.ix_(list(LETTERS), list(MARKS))] = True
    return ~inside & starts


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes of text, one row at least."""
    offsets = _offsets(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


class Memo(dict):
    """fragment -> value; a miss calls make().

    When `rows` are held they become the older half and the half before is forgotten; what
    is met again moves back to the younger half.
    """

    def __init__(self, make: Callable[[bytes], object], rows: int = MEMO_ROWS):
        super().__init__()
        self.make, self.rows, self.old = make, rows, {}

    def __missing__(self, fragment: bytes):
        value = self.old.get(fragment)
        if value is None:
            value = self.make(fragment)
        if len(fragment) <= 64:
            if len(self) >= self.rows:
                self.old = dict(self)
                self.clear()
            self[fragment] = value
        return value


class Coder:
    """Ids of whole texts, fragment by fragment, with a bounded memory of short fragments.

    Fragments of up to 16 bytes are two words of 8 bytes and a length, and are looked up all at
    once in a table of `slots` places with two ways each: equal bytes are equal keys. A miss is
    encoded and takes the first way of its place, what was there moves to the second. Longer
    fragments go through a Memo. Ids lie in a pool; when it is full, the table begins anew.
    """

    SLOTS, POOL = 1 << 18, 1 << 22

    def __init__(self, path: str, cut: np.ndarray, slots: int | None = None):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.make = lambda f: tokenizer.encode(f.decode(), add_special_tokens=False).ids
        self.cut, self.long = cut.reshape(-1), Memo(self.make, 1 << 13)
        self.ways = [[np.zeros(slots or self.SLOTS, t) for t in ("<u8", "<u8", "u1", "<i4", "u1")] for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _hold(self, ids: np.ndarray, at: int) -> None:
        """Puts ids into the pool from place `at` on."""
        end = at + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(end, 2 * len(self.pool)) - at, np.int32)])
        self.pool[at:end] = ids

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids before each text and after the last)."""
        offsets = _offsets(column).astype(np.int64)
        base, end = int(offsets[0]), int(offsets[-1])
        if end == base:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        data = memoryview(column.buffers()[2])[base:end].tobytes()
        codes, rows = np.frombuffer(data, np.uint8), offsets - base
        begins = np.zeros(len(codes), bool)
        begins[1:] = self.cut[codes[:-1].astype(np.uint16) << np.uint16(8) | codes[1:]]
        begins[rows[:-1][rows[:-1] < len(codes)]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(codes)))
        wide = np.ndarray((len(codes) + 9,), "<u8", np.append(codes, np.zeros(16, np.uint8)), strides=(1,))
        one = wide[starts] & HEAD[np.minimum(sizes, 8)]
        two = np.where(sizes > 8, wide[starts + 8] & HEAD[np.clip(sizes - 8, 0, 8)], np.uint64(0))
        with np.errstate(over="ignore"):
            slot = (one * np.uint64(0x9E3779B97F4A7C15) ^ two * np.uint64(0xD6E8FEB86659FD93)) + sizes.astype(np.uint64)
            slot = (slot ^ slot >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - (len(self.ways[0][0]) - 1).bit_length())
        slot = slot.astype(np.int64)
        begin, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        left = np.flatnonzero(sizes <= 16)
        for w0, w1, length, place, n in self.ways:
            at = slot[left]
            hit = (w0[at] == one[left]) & (w1[at] == two[left]) & (length[at] == sizes[left])
            begin[left[hit]], count[left[hit]] = place[at[hit]], n[at[hit]]
            left = left[~hit]
        top = self.used
        for missed in (left, np.flatnonzero(sizes > 16)):
            if not len(missed):
                continue
            numbers: dict[bytes, int] = {}
            number = np.array([numbers.setdefault(data[a:b], len(numbers)) for a, b in zip(starts[missed].tolist(), (starts[missed] + sizes[missed]).tolist())])
            bodies = [self.make(f) for f in numbers] if missed is left else [self.long[f] for f in numbers]
            n = np.array([len(b) for b in bodies], np.int64)
            found, at = np.array([i for b in bodies for i in b], np.int32), np.cumsum(n) - n
            self._hold(found, top)
            begin[missed], count[missed] = top + at[number], n[number]
            top += len(found)
            if missed is left and top <= self.POOL:
                slots, k = np.unique(slot[missed], return_index=True)
                own = missed[k]
                for old, kept in zip(*self.ways):
                    kept[slots] = old[slots]
                for held, value in zip(self.ways[0], (one, two, sizes, begin, count)):
                    held[slots] = value[own]
                self.used = top
        if top > self.POOL:
            for way in self.ways:
                way[2][:] = 0
            self.used = 0
        stop = np.cumsum(count)
        out = self.pool[np.repeat(begin - (stop - count), count) + np.arange(int(stop[-1]))]
        if len(self.pool) > 2 * self.POOL:
            self.pool = self.pool[: self.POOL].copy()
        return out, np.append(0, stop)[np.searchsorted(starts, rows)]


@cache
def kept_coder(path: str, cut: bytes, slots: int | None = None) -> Coder:
    """A coder that a worker keeps between tasks."""
    return Coder(path, np.frombuffer(cut, bool), slots)
