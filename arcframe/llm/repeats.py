"""Repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are sorted through DEPTH bytes only: two suffixes that fall into one group at that
depth begin with the same window, so groups of two or more are exactly the repeated
windows. Passes go from the most significant digit down, and a suffix alone in its bucket
leaves the sort at once.

* First digit: the window's anchor, the DIGIT-byte string within it whose hash is smallest
  (leftmost on ties). Equal windows have equal anchors at equal offsets, and neighbouring
  suffixes share theirs, so a run of about 50 suffixes is one entry of this pass.
* Second digit: a run's whole stretch of bytes. Runs that agree in it have all of their
  suffixes in common groups; they are done.
* Last digit: for the runs left over (ends of repeated passages) the rest of each window.

The anchor is told by a polynomial hash mod 2**64, whose low bits are weak on texts such as
Thue-Morse strings; a collision there only puts more runs into one bucket. What decides a
group is the hash of its bytes modulo the prime 2**61 - 1, where two strings of n letters
collide for at most n of its bases. Entries travel packed by slice of the input; what repeats
within a slice is folded there, so an owner gets one entry a slice of even the commonest passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import mix64, shuffle_width, text_bytes, written
from arcframe.llm.fragments import slices

DEPTH, DIGIT = 200, 100
#: Bytes of text that a task packs together.
PACK_BYTES = 3 << 19
#: Texts are cut into stretches of so many windows at most; positions fit into POSITION_BITS.
STRETCH, POSITION_BITS = 1 << 23, 24
#: Runs of one anchor within a pack beyond which they go to the last pass directly.
CROWD = 8
#: Bytes of text whose entries an owner gets in the mean; there are as many owners as that takes.
OWNER_BYTES = 4 << 20
#: Intervals and open runs up to this size are broadcast to the texts.
BROADCAST_BYTES = 2 << 20

SENT = "owner int, kind int, n_texts int, body binary"
FOUND = "text_key binary, kind int, body binary"
ENTRY = np.dtype([("h", "<u8"), ("r", "<u8"), ("i", "<u4"), ("n", "u1"), ("d", "u1"), ("text", "<u4"), ("twice", "u1")])
RUN = np.dtype([("h", "<u8"), ("i", "<u4"), ("n", "u1"), ("d", "u1"), ("text", "<u4")])
WINDOW = np.dtype([("h", "<u8"), ("c", "<u4"), ("run", "<u4"), ("o", "u1"), ("twice", "u1")])
SPAN = np.dtype([("a", "<u4"), ("b", "<u4"), ("text", "<u4")])


class Hasher:
    """Hashes of all strings of a given length, from prefix sums of a polynomial mod 2**64."""

    def __init__(self, seed: int, base: int):
        self.table = mix64(np.arange(seed, seed + 256, dtype=np.uint64))
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.power = self.unpower = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        while len(self.power) < n + 1:
            self.power = np.concatenate([self.power, self.power * (self.power[-1] * self.base)])
            self.unpower = np.concatenate([self.unpower, self.unpower * (self.unpower[-1] * self.inverse)])
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=out[1:])
        return out

    def strings(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[begin]) * self.unpower[begin] + (end - begin).astype(np.uint64))


class PrimeHasher:
    """As Hasher, modulo the prime 2**61 - 1: no text makes differences that the modulus swallows."""

    PRIME = np.uint64((1 << 61) - 1)
    LOW = np.uint64((1 << 32) - 1)
    #: Letters that go through at once: temporary arrays stay small however long a text is.
    AT_ONCE = 1 << 15

    def __init__(self, seed: int, base: int):
        self.table = mix64(np.arange(seed, seed + 256, dtype=np.uint64)) % self.PRIME
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, int(self.PRIME)))
        self.power = self.unpower = np.ones(1, np.uint64)

    def folded(self, x: np.ndarray) -> np.ndarray:
        """x modulo the prime, for any 64-bit x."""
        x = (x & self.PRIME) + (x >> np.uint64(61))
        return np.minimum(x, x - self.PRIME)

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """x * 2**32, not quite reduced (under 2**61 + 2**35)."""
        return (x >> np.uint64(29)) + ((x & np.uint64((1 << 29) - 1)) << np.uint64(32))

    def times(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a * b modulo the prime, both under it, from products of halves (2**64 is 8 there)."""
        if len(a) > self.AT_ONCE:
            out = np.empty(len(a), np.uint64)
            for lo in range(0, len(a), self.AT_ONCE):
                part = slice(lo, lo + self.AT_ONCE)
                out[part] = self.times(a[part], b[part] if np.size(b) == len(a) else b)
            return out
        a1, a0, b1, b0 = a >> np.uint64(32), a & self.LOW, b >> np.uint64(32), b & self.LOW
        least = a0 * b0
        return self.folded(((a1 * b1) << np.uint64(3)) + self.shifted(a1 * b0 + a0 * b1) + (least & self.PRIME) + (least >> np.uint64(61)))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        while len(self.power) < n + 1:
            self.power = np.concatenate([self.power, self.times(self.power, self.times(self.power[-1:], self.base))])
            self.unpower = np.concatenate([self.unpower, self.times(self.unpower, self.times(self.unpower[-1:], self.inverse))])
        out = np.zeros(n + 1, np.uint64)
        for lo in range(0, n, self.AT_ONCE):
            hi = min(n, lo + self.AT_ONCE)
            terms = self.times(self.table[data[lo:hi]], self.power[lo:hi])
            # Halves are summed apart, so that neither sum passes 64 bits.
            low, high = np.cumsum(terms & self.LOW), np.cumsum(terms >> np.uint64(32))
            out[lo + 1 : hi + 1] = self.folded(low + self.shifted(high) + out[lo])
        return out

    def strings(self, prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = self.times(self.folded(prefix[end] + self.PRIME - prefix[begin]), self.unpower[begin])
        return mix64(value + (end - begin).astype(np.uint64))


FIRST, SECOND = Hasher(90_001, 0x9E3779B97F4A7C15), PrimeHasher(95_001, 0x1B873593CC9E2D51)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor position, anchor hash) of the runs of one text."""
    width = DEPTH - DIGIT + 1
    low = np.uint64((1 << POSITION_BITS) - 1)
    parts = []
    with np.errstate(over="ignore"):
        prefix = FIRST.prefix(data)
        for base in range(0, max(0, len(data) - DEPTH + 1), STRETCH):
            stop = min(len(data), base + STRETCH + DEPTH - 1)
            at = np.arange(base, stop - DIGIT + 1)
            h = mix64((prefix[base + DIGIT : stop + 1] - prefix[base : stop - DIGIT + 1]) * FIRST.unpower[at])
            least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            step, n = 1, len(h) - width + 1
            while 2 * step <= width:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            least = np.minimum(least[:n], least[width - step : width - step + n])
            anchor = (least & low).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            count = np.diff(np.r_[begin, n])
            parts.append((begin + base, count, anchor[begin] + base, h[anchor[begin]]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _pack(rows: list, owners: np.ndarray, table: np.ndarray, keys: list[bytes], kind: int) -> None:
    """Appends one row (owner, kind, n_texts, body) per owner: keys of the texts, then entries."""
    by = np.argsort(owners, kind="stable")
    owners, table = owners[by], table[by]
    cuts = np.flatnonzero(np.diff(owners)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(owners)]):
        if hi > lo:
            part = table[lo:hi].copy()
            used, part["text"] = np.unique(part["text"], return_inverse=True)
            rows.append((int(owners[lo]), kind, len(used), b"".join([keys[u] for u in used]) + part.tobytes()))


def _unpack(n: int, body: bytes, dtype: np.dtype) -> tuple[list[bytes], np.ndarray]:
    return [body[16 * i : 16 * i + 16] for i in range(n)], np.frombuffer(body, dtype, -1, 16 * n)


def _sent(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["owner", "kind", "n_texts", "body"])


def _owner_of_texts(keys: list[bytes], index: np.ndarray, owners: int) -> np.ndarray:
    own = np.frombuffer(b"".join(keys), "<u8")[::2] % np.uint64(owners)
    return own.astype(np.int64)[index]


def _packed(make):
    """Collects distinct texts of about PACK_BYTES, then yields make(items) where it is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held = {}, 0
        for batch in batches:
            for i, text in enumerate(text_bytes(batch.column(0))):
                key = _key(text)
                if key not in items:
                    items[key] = (text, batch.column(1)[i].as_py() if batch.num_columns > 1 else None)
                    held += len(text)
                if held >= PACK_BYTES:
                    rows = make(items)
                    if rows:
                        yield _sent(rows)
                    items, held = {}, 0
        rows = make(items) if items else []
        if rows:
            yield _sent(rows)

    return run


def _first_pass(owners: int):
    """Entries of the first digit, by owner of the anchor (kind 0), with those folded here.

    Kind 1: covered stretches; kind 2: runs for the last pass; both by owner of the text.
    """

    def make(items: dict[bytes, tuple[bytes, None]]) -> list:
        keys, tables = list(items), []
        for number, (text, _) in enumerate(items.values()):
            if len(text) < DEPTH:
                continue
            data = np.frombuffer(text, np.uint8)
            begin, count, anchor, h = runs(data)
            with np.errstate(over="ignore"):
                r = SECOND.strings(SECOND.prefix(data), begin, begin + count - 1 + DEPTH)
            table = np.zeros(len(begin), ENTRY)
            table["h"], table["r"], table["i"], table["n"], table["d"], table["text"] = h, r, begin, count, anchor - begin, number
            tables.append(table)
        rows = []
        if not tables:
            return rows
        table = np.concatenate(tables)
        table = table[np.lexsort((table["d"], table["n"], table["r"], table["h"]))]
        same = (table["h"][1:] == table["h"][:-1]) & (table["r"][1:] == table["r"][:-1]) & (table["n"][1:] == table["n"][:-1]) & (table["d"][1:] == table["d"][:-1])
        begin = np.flatnonzero(np.r_[True, ~same])
        count = np.diff(np.r_[begin, len(table)])
        covered = table[np.repeat(count > 1, count)]
        _pack(rows, _owner_of_texts(keys, covered["text"], owners), _stretches(covered), keys, 1)
        table["twice"][begin] = count > 1
        table = table[begin]
        group = np.cumsum(np.r_[True, table["h"][1:] != table["h"][:-1]]) - 1
        rank = np.arange(len(table)) - np.searchsorted(group, group, "left")
        crowded = np.bincount(group)[group] > CROWD
        crowd = table[crowded]
        _pack(rows, _owner_of_texts(keys, crowd["text"], owners), _runs(crowd), keys, 2)
        table = table[rank < CROWD]
        _pack(rows, (mix64(table["h"]) % np.uint64(owners)).astype(np.int64), table, keys, 0)
        return rows

    return _packed(make)


def _stretches(entries: np.ndarray) -> np.ndarray:
    out = np.zeros(len(entries), SPAN)
    out["a"], out["b"], out["text"] = entries["i"], entries["i"] + entries["n"] - 1 + DEPTH, entries["text"]
    return out


def _runs(entries: np.ndarray) -> np.ndarray:
    out = np.zeros(len(entries), RUN)
    for name in RUN.names:
        out[name] = entries[name]
    return out


def _by_text(keys: list[bytes], table: np.ndarray, kind: int) -> pd.DataFrame:
    """One row per text: its key, the kind and its entries."""
    if not len(table):
        return pd.DataFrame({"text_key": [], "kind": [], "body": []})
    table = table[np.argsort(table["text"], kind="stable")]
    cuts = np.flatnonzero(np.diff(table["text"])) + 1
    parts = [(keys[table["text"][lo]], kind, table[lo:hi].tobytes()) for lo, hi in zip([0, *cuts], [*cuts, len(table)])]
    return pd.DataFrame(parts, columns=["text_key", "kind", "body"])


def _gathered(rows: pd.DataFrame, kind: int, dtype: np.dtype) -> tuple[list[bytes], np.ndarray]:
    """All entries of a kind, with text numbers over the distinct keys."""
    index, keys, tables = {}, [], []
    part = rows[rows["kind"] == kind]
    for n, body in zip(part["n_texts"], part["body"]):
        own, table = _unpack(n, body, dtype)
        table = table.copy()
        numbers = np.array([index.setdefault(k, len(index)) for k in own], np.uint32)
        keys += [k for k, i in zip(own, numbers) if i >= len(keys)]
        table["text"] = numbers[table["text"]]
        tables.append(table)
    return keys, np.concatenate(tables) if tables else np.zeros(0, dtype)


def _first_owner(rows: pd.DataFrame) -> pd.DataFrame:
    """Second digit: stretches that occur twice (kind 1) and runs for the last pass (kind 2)."""
    out = [_by_text(*_gathered(rows, 1, SPAN), 1), _by_text(*_gathered(rows, 2, RUN), 2)]
    keys, table = _gathered(rows, 0, ENTRY)
    if len(table):
        table = table[np.lexsort((table["i"], table["text"], table["d"], table["n"], table["r"], table["h"]))]
        alike = lambda *names: np.logical_and.reduce([table[x][1:] == table[x][:-1] for x in names])
        first = np.r_[True, ~alike("h", "r", "n", "d", "text", "i")]
        twice = np.maximum.reduceat(table["twice"], np.flatnonzero(first))
        table = table[first]
        table["twice"] = twice
        begin = np.flatnonzero(np.r_[True, ~alike("h", "r", "n", "d")])
        count = np.diff(np.r_[begin, len(table)])
        out.append(_by_text(keys, _stretches(table[np.repeat(count > 1, count)]), 1))
        heads = table[begin]
        group = np.cumsum(np.r_[True, heads["h"][1:] != heads["h"][:-1]]) - 1
        out.append(_by_text(keys, _runs(heads[np.bincount(group)[group] > 1]), 2))
    return pd.concat(out, ignore_index=True).astype({"kind": "int32"})


def _last_pass(owners: int):
    """(text, open runs) -> windows by owner of their digits (kind 0) and stretches folded here (kind 1)."""

    def make(items: dict[bytes, tuple[bytes, bytes]]) -> list:
        keys, run_tables, tables, routes, total = list(items), [], [], [], 0
        for number, (text, body) in enumerate(items.values()):
            own = np.frombuffer(body, RUN).copy()
            own["text"] = number
            own = np.unique(own)
            data = np.frombuffer(text, np.uint8)
            size = own["n"].astype(np.int64)
            which = np.repeat(np.arange(len(own)), size)
            offset = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            begin = own["i"][which].astype(np.int64) + offset
            table = np.zeros(len(which), WINDOW)
            with np.errstate(over="ignore"):
                strings = SECOND.strings(SECOND.prefix(data), begin, begin + DEPTH)
                table["h"] = mix64(strings + mix64(own["h"])[which])
            table["c"] = own["h"][which] & np.uint64(0xFFFFFFFF)
            # Equal windows have equal anchors at equal distances: a run's windows go to a few owners, not to all.
            routes.append(mix64(own["h"][which] + ((own["d"][which].astype(np.int64) - offset) >> 5).astype(np.uint64)) % np.uint64(owners))
            table["run"], table["o"] = which + total, offset
            marked = np.zeros(len(own), SPAN)
            marked["a"], marked["text"] = own["i"], number
            run_tables.append(marked)
            tables.append(table)
            total += len(own)
        rows = []
        table, known, route = np.concatenate(tables), np.concatenate(run_tables), np.concatenate(routes).astype(np.int64)
        by = np.lexsort((table["c"], table["h"]))
        table, route = table[by], route[by]
        begin = np.flatnonzero(np.r_[True, (table["h"][1:] != table["h"][:-1]) | (table["c"][1:] != table["c"][:-1])])
        count = np.diff(np.r_[begin, len(table)])
        spans = _matched(table[np.repeat(count > 1, count)], known)
        _pack(rows, _owner_of_texts(keys, spans["text"], owners), spans, keys, 1)
        table["twice"][begin] = count > 1
        table, owner = table[begin], route[begin]
        by = np.argsort(owner, kind="stable")
        owner, table = owner[by], table[by]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(owner)]):
            part = table[lo:hi].copy()
            used, part["run"] = np.unique(part["run"], return_inverse=True)
            own = known[used]
            texts, own["text"] = np.unique(own["text"], return_inverse=True)
            body = len(used).to_bytes(4, "little") + b"".join([keys[t] for t in texts]) + own.tobytes() + part.tobytes()
            rows.append((int(owner[lo]), 0, len(texts), body))
        return rows

    return _packed(make)


def _matched(windows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Per run with matched windows the stretch from the first to the last: they overlap."""
    if not len(windows):
        return np.zeros(0, SPAN)
    windows = windows[np.lexsort((windows["o"], windows["run"]))]
    begin = np.flatnonzero(np.r_[True, windows["run"][1:] != windows["run"][:-1]])
    end = np.r_[begin[1:], len(windows)] - 1
    out = known[windows["run"][begin]].copy()
    out["b"] = out["a"] + windows["o"][end] + np.uint32(DEPTH)
    out["a"] += windows["o"][begin]
    return out


def _last_owner(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows in groups of two or more -> stretches (kind 1)."""
    out = [_by_text(*_gathered(rows, 1, SPAN), 1)]
    index, keys, tables, runs_known, total = {}, [], [], [], 0
    part = rows[rows["kind"] == 0]
    for n, body in zip(part["n_texts"], part["body"]):
        m = int.from_bytes(body[:4], "little")
        own = [body[4 + 16 * i : 20 + 16 * i] for i in range(n)]
        at = 4 + 16 * n
        known = np.frombuffer(body, SPAN, m, at).copy()
        table = np.frombuffer(body, WINDOW, -1, at + m * SPAN.itemsize).copy()
        numbers = np.array([index.setdefault(k, len(index)) for k in own], np.uint32)
        keys += [k for k, i in zip(own, numbers) if i >= len(keys)]
        known["text"] = numbers[known["text"]]
        table["run"] += total
        total += m
        runs_known.append(known)
        tables.append(table)
    if tables:
        table, known = np.concatenate(tables), np.concatenate(runs_known)
        start = known["a"][table["run"]] + table["o"]
        text = known["text"][table["run"]]
        by = np.lexsort((start, text, table["c"], table["h"]))
        table, start, text = table[by], start[by], text[by]
        group = np.r_[True, (table["h"][1:] != table["h"][:-1]) | (table["c"][1:] != table["c"][:-1])]
        fresh = group | np.r_[True, (start[1:] != start[:-1]) | (text[1:] != text[:-1])]
        number = np.cumsum(group) - 1
        different = np.bincount(number, fresh)
        twice = np.zeros(len(different), bool)
        np.logical_or.at(twice, number, table["twice"] > 0)
        out.append(_by_text(keys, _matched(table[((different > 1) | twice)[number]], known), 1))
    return pd.concat(out, ignore_index=True).astype({"kind": "int32"})


def removed(spans: list[bytes], size: int) -> list[tuple[int, int]]:
    """Maximal stretches of the union of SPAN entries."""
    table = np.concatenate([np.frombuffer(b, SPAN) for b in spans])
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, table["a"], 1)
    np.add.at(edge, table["b"], -1)
    inside = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def _outcome(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans or null, copies) -> the removed spans and the kept bytes of each row."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            sizes, every, bodies = [], [], []
            for text, spans, copies in zip(text_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if copies > 1 and len(text) >= DEPTH:
                    cuts = [(0, len(text))]
                else:
                    cuts = removed(spans, len(text)) if spans else []
                ends = [0, *(e for _, e in cuts)]
                sizes.append(len(text))
                every.append([{"begin": x, "end": y} for x, y in cuts])
                bodies.append(b"".join([text[x:y] for x, y in zip(ends, [*(x for x, _ in cuts), len(text)])]))
            columns = [pa.array(sizes, pa.int64()), pa.array(every, pa.list_(span)), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n_bytes", "spans", "kept"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_key(t) for t in text_bytes(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["id", "text", "text_key"])


def _joined(texts: DataFrame, side: DataFrame, size: int, how: str) -> DataFrame:
    """texts with the rows of side, which are broadcast where their bytes are few."""
    return texts.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, "text_key", how)


def _bytes(df: DataFrame, column) -> int:
    return df.agg(F.sum(column)).first()[0] or 0


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, spans (begin, end: the bytes removed), kept (the bytes left).

    Texts are UTF-8 bytes (null: none). A byte goes when a DEPTH-byte string that covers it
    also starts elsewhere, in the same text or in another row; windows never cross rows.
    Rows with equal texts are copies of each other: from DEPTH bytes on they go whole.
    Repeated and null ids stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = plain.mapInArrow(_keys, f"id {kind}, text string, text_key binary")
    size = _bytes(plain, F.octet_length("text"))
    owners = max(2, 2 * shuffle_width(spark), size // OWNER_BYTES)
    sent = plain.select("text").mapInArrow(_first_pass(owners), SENT)
    found = written(sent.groupBy("owner").applyInPandas(_first_owner, FOUND), "repeats")
    bodies = F.collect_list("body").alias("bodies")
    opened = found.where("kind = 2").groupBy("text_key").agg(bodies)
    opened = written(opened.select("text_key", F.expr("aggregate(bodies, cast('' as binary), (x, y) -> concat(x, y))").alias("body")), "open-runs")
    with_runs = _joined(texts.select("text", "text_key"), opened, _bytes(opened, F.octet_length("body") + 16), "inner")
    windows = with_runs.select("text", "body").mapInArrow(_last_pass(owners), SENT)
    more = written(windows.groupBy("owner").applyInPandas(_last_owner, FOUND), "windows")
    spans = found.where("kind = 1").unionByName(more).groupBy("text_key").agg(bodies)
    copies = texts.select("text_key").groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    facts = written(spans.join(copies, "text_key", "full_outer"), "spans")
    held = _bytes(facts, F.expr("16 + aggregate(coalesce(bodies, array()), 0, (n, x) -> n + octet_length(x))"))
    rows = _joined(texts, facts, held, "left").select("id", "text", "bodies", F.coalesce("copies", F.lit(1)).alias("copies"))
    return rows.mapInArrow(_outcome, f"id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures of without_repeats() per row: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    left = F.octet_length("kept").cast("long")
    return without_repeats(docs, id_col, text_col).select(
        id_col, "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
