"""Jaccard self-join on word shingles by vertical partitioning.

1. Sets are reduced to classes: texts with equal shingle sets are one member from here on,
   however many copies there are.
2. Of each class the shingles below SKETCH (three eighths of all) go to owners as Rice-coded
   fingerprints, and bitmaps come back: which of them occur elsewhere. A set that links lacks a
   quarter of its shingles at most, so one that misses more of these has no link and is done.
   Wrong matches of fingerprints only keep sets that could have gone. The other classes are
   told by a bitmap of their numbers, CLASS_BITS at most.
3. All shingles of these classes are dealt by their hash to owners, packed by slices of the sets. Owners count
   the classes that hold a shingle and send back those that two or more hold. That gives one
   global order: the binary magnitude of the count, then the hash; shingles of one class
   come first and need not be named. A table of at most 64 magnitudes cuts the order into
   FRAGMENTS ranges of equal size.
4. Linked sets share a shingle of their prefixes in that order. The least class that holds a
   shingle in its prefix leads it, and all sets of the shingle join the group of that leader:
   a family of near copies shares dozens of prefix shingles, but few leaders, so each set
   joins few groups and two linked sets have a group in common. No pair is made here.
5. Groups are cut into blocks, and every pair of blocks is a unit of bounded size. Each
   (unit, fragment) counts the partial overlaps of its sets apart from all others and gives
   one matrix of counts; the matrices of a unit are summed per pair, which tests the Jaccard
   bound exactly.
6. A pair with several common groups counts in that of the least leader. Units return the
   number of links of each set and a forest of what they connect, or, on demand, every pair.

Shingles are 64-bit hashes; counts are exact for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm import golomb
from arcframe.llm.common import fresh_name, lean, lean_group, lean_pair, shuffle_width, written
from arcframe.llm.components import connected_components
from arcframe.llm.fragments import slices
from arcframe.llm.shingles import WORDS, shingle_sets

PERCENT = 75
#: Ranges of the global order.
FRAGMENTS = 4
#: A slice tells a shingle that so many of its sets hold; that finds the hot ones.
TOLD = 3
#: Hot shingles that are dealt to more than one owner at most (16 bytes each).
HOT_ROWS = 1 << 18
#: Members and shingles of a block; in groups of more than 16 blocks they grow up to 4 times.
BLOCK_ROWS, BLOCK_TOKENS = 500, 1 << 19
#: Shingles of one owner in the mean, and members of one part of a hot shingle.
OWNER_ROWS, PART_ROWS = 1 << 19, 20_000
#: Sets and shingles that a task packs together.
PACK_SETS, PACK_SHINGLES = 60_000, 1 << 20
#: Shingles and pairs of the units that one group of rows counts, in the mean.
UNIT_TOKENS, UNIT_PAIRS = 1 << 21, 1 << 22
#: Work of one step of a count in a unit: pairs that meet in a shingle, and shingles of a product of matrices.
STEP_PAIRS, STEP_TOKENS = 1 << 20, 512

#: Ids of rows that go up to this number are broadcast to documents; beyond it they are joined by key.
BROADCAST_IDS = 1_000_000
#: Shingles whose hash is below it are sketched; bits of a fingerprint beyond those that number the shingles.
SKETCH, SPARE_BITS = np.uint64(3 << 61), 8
#: Bits of the map of classes that may have links: 16 a class, 2 to this power at most.
CLASS_BITS = 29

SKETCHED = "pack long, owner int, n int, k int, body binary, twice binary"
FACTS = "kind int, id {kind}, n long, class long, high long"
SENT = "owner int, n_sets int, body binary"
BACK = "home int, n_sets int, body binary, magnitude int, entries long"
REDUCED = "class long, n long, prefix array<long>, segments array<binary>"
UNIT = ["leader", "p", "q"]
PARTIAL = "pack long, leader long, p int, q int, fragment int, counts binary"
OUT = "kind int, a long, b long, na long, nb long, n long"


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    low, high = np.frombuffer(raw, "<i8")
    return int(low), int(high)


def _facts(width: int):
    """(id, text) -> kind 0: id, set size, class; kind 1: a shingle and its sets in a slice (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            ids = batch.column(0)
            for lo, hi in slices(batch.column(1)):
                pairs, sizes, seen = [], [], {}
                for tokens in shingle_sets(batch.column(1).slice(lo, hi - lo), width):
                    pair = _digest(tokens)
                    pairs.append(pair)
                    sizes.append(len(tokens))
                    seen[pair] = tokens
                values, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                told = counts >= TOLD
                values, counts = values[told].view(np.int64), counts[told]
                n, m = hi - lo, len(values)
                own = np.array(pairs, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1], [n, m]), pa.int32()),
                        pa.concat_arrays([ids.slice(lo, n), pa.nulls(m, ids.type)]),
                        pa.array(np.concatenate([sizes, counts]).astype(np.int64)),
                        pa.array(np.concatenate([own[:, 0], values])),
                        pa.array(np.concatenate([own[:, 1], np.zeros(m, np.int64)])),
                    ],
                    names=["kind", "id", "n", "class", "high"],
                )

    return run


class Hot:
    """Shingles of so many sets that several owners share each of them, with those told."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens, self.counts = tokens[by], counts[by]

    def told(self, tokens: np.ndarray) -> np.ndarray:
        """Sets told of each shingle, 0 where it is not hot."""
        out = np.zeros(len(tokens), np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            known = self.tokens[at] == tokens
            out[known] = self.counts[at[known]]
        return out


def hot_shingles(facts: DataFrame) -> Hot:
    told = facts.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n"))
    rows = told.where(F.col("n") >= PART_ROWS).orderBy(F.desc("n"), "class").limit(HOT_ROWS).toPandas()
    return Hot(rows["class"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def prefix_length(n, percent: int = PERCENT):
    """Shingles of a set of n of which every partner shares one at least."""
    return n - -(-n * percent // 100) + 1


def _bits(n: int) -> np.uint64:
    """The shift that leaves a number below n (a power of two) of a 64-bit hash."""
    return np.uint64(65 - n.bit_length())


def _pack(keys: np.ndarray, classes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(key, sets, body) for each run of equal keys; byte planes of sorted tokens compress well."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(keys)]) if len(keys) else ():
        used, first, local = np.unique(classes[lo:hi], return_index=True, return_inverse=True)
        body = [used.tobytes(), sizes[lo:hi][first].astype("<i4").tobytes(), tokens[lo:hi].view(np.uint8).reshape(-1, 8).T.tobytes()]
        body += [local.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), *(x[lo:hi].tobytes() for x in more)]
        yield int(keys[lo]), len(used), b"".join(body)


def _unpack(n_sets, bodies, more: int) -> list[np.ndarray]:
    """Class, size and token of each entry, and as many arrays of bytes as _pack() was given more."""
    out = []
    for n, body in zip(n_sets, bodies):
        kind = "<u2" if n <= 1 << 16 else "<u4"
        wide = np.dtype(kind).itemsize
        m = (len(body) - 12 * n) // (8 + wide + more)
        local = np.frombuffer(body, kind, m, 12 * n + 8 * m)
        tokens = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * m, 12 * n).reshape(8, m).T).view("<u8")[:, 0]
        rest = [np.frombuffer(body, np.uint8, m, 12 * n + (8 + wide + i) * m) for i in range(more)]
        out.append((np.frombuffer(body, "<i8", n)[local], np.frombuffer(body, "<i4", n, 8 * n)[local].astype(np.int64), tokens, *rest))
    return [np.concatenate(x) for x in zip(*out)]


def _sketches(moved: dict[tuple[int, int], int], bits: int, owner_bits: int, width: int):
    """(text) -> per pack of sets: owner -1: their classes, sizes, and the set of each sketched shingle in the order of
    fingerprints (twice: where a new one begins); other owners: fingerprints, and which of them two sets of the pack hold."""
    rest = bits - owner_bits

    def pack(number: int, sets: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sizes, tokens = zip(*sets.values())
        values = (np.concatenate(tokens) >> np.uint64(64 - bits)).astype(np.int64)
        by = np.argsort(values, kind="stable")
        values, local = values[by], np.repeat(np.arange(len(sets)), [len(t) for t in tokens])[by]
        fresh = np.append(True, values[1:] != values[:-1])[: len(values)]
        begin = np.flatnonzero(fresh)
        values, count = values[begin], np.diff(np.append(begin, len(values)))
        body = np.array(list(sets), "<i8").tobytes() + np.array(sizes, "<i4").tobytes() + local.astype("<u2").tobytes()
        rows = [(number, -1, len(sets), 0, body, np.packbits(fresh).tobytes())]
        cuts = np.flatnonzero(np.diff(values >> rest)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(values)]) if len(values) else ():
            o, k = int(values[lo]) >> rest, golomb.rice_parameter(1 << rest, hi - lo)
            rows.append((number, o, hi - lo, k, golomb.encode(values[lo:hi] - (o << rest), k), np.packbits(count[lo:hi] > 1).tobytes()))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["pack", "owner", "n", "k", "body", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sets, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in lean(batches):
            for lo, hi in slices(batch.column(0)):
                for tokens in shingle_sets(batch.column(0).slice(lo, hi - lo), width):
                    if len(tokens):
                        pair = _digest(tokens)
                        own = moved.get(pair, pair[0])
                        if own not in sets:
                            sets[own] = (len(tokens), tokens[: np.searchsorted(tokens, SKETCH)].copy())
                            held += len(sets[own][1])
                    if len(sets) >= PACK_SETS or held >= PACK_SHINGLES:
                        yield pack(number, sets)
                        number, sets, held = number + 1, {}, 0
        if sets:
            yield pack(number, sets)

    return run


def _hopeful(percent: int):
    """Sets and answers of one pack -> class and size of each set that meets enough others to have a link."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["owner"] < 0].iloc[0]
        answers = rows[rows["owner"] >= 0].sort_values("owner")
        m, body = int(own["n"]), own["body"]
        classes, sizes = np.frombuffer(body, "<i8", m), np.frombuffer(body, "<i4", m, 8 * m).astype(np.int64)
        local = np.frombuffer(body, "<u2", -1, 12 * m) if len(body) > 12 * m else np.zeros(0, "<u2")
        met = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(answers["twice"], answers["n"]))])
        fresh = np.unpackbits(np.frombuffer(own["twice"], np.uint8), count=len(local))
        missed = np.bincount(local[met[np.cumsum(fresh, dtype=np.int64) - 1] == 0], minlength=m)
        keep = missed <= sizes - -(-sizes * percent // 100)
        return pd.DataFrame({"class": classes[keep], "n": sizes[keep]})

    return run


class Marked:
    """A bitmap of class numbers by their first bits; numbers that are not in it may be held as well."""

    def __init__(self, bits: int, body: bytes):
        self.shift, self.body = 64 - bits, body

    def holds(self, own: int) -> bool:
        at = (own & 0xFFFFFFFFFFFFFFFF) >> self.shift
        return bool(self.body[at >> 3] >> (7 - (at & 7)) & 1)


def _marked(classes: DataFrame, count: int) -> Marked:
    """The map of these classes: each part of it is one task's, the driver gets 2 ** CLASS_BITS bits at most."""
    bits = min(CLASS_BITS, max(16, count.bit_length() + 4))
    part = min(10, bits - 13)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["class"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
        flags = np.zeros(1 << (bits - part), bool)
        flags[(at & np.uint64(len(flags) - 1)).astype(np.int64)] = True
        return pd.DataFrame({"part": [int(at[0]) >> (bits - part)], "body": [np.packbits(flags).tobytes()]})

    keyed = classes.select("class", F.shiftrightunsigned("class", 64 - part).alias("part")).distinct()
    body, step = bytearray(1 << (bits - 3)), 1 << (bits - part - 3)
    for row in keyed.groupBy("part").applyInPandas(fill, "part long, body binary").collect():
        body[row["part"] * step : (row["part"] + 1) * step] = row["body"]
    return Marked(bits, bytes(body))


def _linkable(texts: DataFrame, moved: dict[tuple[int, int], int], total: int, percent: int, width: int) -> tuple[Marked, int]:
    """(the map of classes that may have links, shingles of their sets); total: shingles of all sets."""
    owners = max(2, shuffle_width(texts.sparkSession), total // OWNER_ROWS)
    owner_bits = (owners - 1).bit_length()
    bits = min(60, max(total.bit_length() + SPARE_BITS, owner_bits + 1))
    sent = written(texts.select("text").mapInArrow(_sketches(moved, bits, owner_bits, width), SKETCHED), "sketches")
    answers = sent.where("owner >= 0").groupBy("owner").applyInPandas(lean_group(golomb.answered), SKETCHED)
    found = sent.where("owner < 0").unionByName(answers).groupBy("pack").applyInPandas(lean_group(_hopeful(percent)), "class long, n long")
    found = written(found, "linkable")
    sums = found.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("n")).first()
    return _marked(found, sums["sets"]), sums["n"] or 0


def _sets(hot, marked, moved: dict[tuple[int, int], int], owners: int, width: int):
    """(text) -> whole sets of marked classes by owner of their shingles, packed; a class once in a pack."""

    def pack(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        each = [len(t) for t in sets.values()]
        tokens = np.concatenate(list(sets.values()))
        by = np.argsort(tokens)
        tokens = tokens[by]
        classes, sizes = (np.repeat(np.array(x, np.int64), each)[by] for x in (list(sets), each))
        owner = (tokens >> _bits(owners)).astype(np.int64)
        parts = hot.value.told(tokens) // PART_ROWS + 1
        split = parts > 1
        if split.any():
            owner[split] = (owner[split] + (classes[split] & 0x7FFFFFFF) % parts[split]) % owners
            by = np.argsort(owner, kind="stable")
            owner, classes, sizes, tokens = owner[by], classes[by], sizes[by], tokens[by]
        rows = zip(*_pack(owner, classes, sizes, tokens))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int32(), pa.binary()))], names=["owner", "n_sets", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for batch in lean(batches):
            for lo, hi in slices(batch.column(0)):
                for tokens in shingle_sets(batch.column(0).slice(lo, hi - lo), width):
                    if len(tokens):
                        pair = _digest(tokens)
                        own = moved.get(pair, pair[0])
                        if own not in sets and marked.value.holds(own):
                            sets[own] = tokens
                            held += len(tokens)
                    if len(sets) >= PACK_SETS or held >= PACK_SHINGLES:
                        yield pack(sets)
                        sets, held = {}, 0
        if sets:
            yield pack(sets)

    return run


def _shared(hot, homes: int):
    """Packed sets of one owner -> shingles of two classes or more with the magnitude of their
    count, packed by home of the class, and how many entries each magnitude has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        classes, sizes, tokens = _unpack(rows["n_sets"], rows["body"], 0)
        by = np.lexsort((classes, tokens))
        classes, sizes, tokens = classes[by], sizes[by], tokens[by]
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1]))
        classes, sizes, tokens = classes[fresh], sizes[fresh], tokens[fresh]
        begin = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        count = np.diff(np.append(begin, len(tokens)))
        told = hot.value.told(tokens[begin])
        magnitude = np.repeat(np.frexp(np.where(told > 0, told, count))[1], count).astype(np.uint8)
        keep = magnitude > 1
        classes, sizes, tokens, magnitude = classes[keep], sizes[keep], tokens[keep], magnitude[keep]
        home = (classes.view(np.uint64) >> _bits(homes)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        out = [(*x, None, None) for x in _pack(home[by], classes[by], sizes[by], tokens[by], magnitude[by])]
        kinds, entries = np.unique(magnitude, return_counts=True)
        out += [(None, None, None, k, n) for k, n in zip(kinds.tolist(), entries.tolist())]
        return pd.DataFrame(out, columns=["home", "n_sets", "body", "magnitude", "entries"]).astype({k: "Int64" for k in ("home", "n_sets", "magnitude", "entries")})

    return run


class Cuts:
    """Ranges of the global order (magnitude, then hash) with equal numbers of entries."""

    def __init__(self, entries: dict[int, int]):
        share = np.zeros(65)
        for magnitude, n in entries.items():
            share[magnitude] = n
        self.share = share / max(1.0, share.sum())
        self.before = np.cumsum(self.share) - self.share

    def fragment(self, tokens: np.ndarray, magnitudes: np.ndarray) -> np.ndarray:
        place = self.before[magnitudes] + self.share[magnitudes] * (tokens / 2.0**64)
        return np.minimum((place * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)


def _reduced(cuts: Cuts, percent: int):
    """Shared shingles of the classes of one home -> each class with a shared shingle in its prefix:
    that part of the prefix, and its shared shingles by ranges of the global order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        classes, sizes, tokens, magnitude = _unpack(rows["n_sets"], rows["body"], 1)
        by = np.lexsort((tokens, magnitude, classes))
        classes, sizes, tokens = classes[by], sizes[by], tokens[by]
        part = cuts.fragment(tokens, magnitude[by])
        begin = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
        end = np.append(begin[1:], len(classes))
        first = prefix_length(sizes[begin], percent) - sizes[begin] + end - begin
        out = []
        for lo, hi, k in zip(begin, end, first):
            if k > 0:
                edges = lo + np.searchsorted(part[lo:hi], np.arange(FRAGMENTS + 1))
                segments = [np.sort(tokens[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
                out.append((classes[lo], sizes[lo], tokens[lo : lo + k].view(np.int64), segments))
        return pd.DataFrame(out, columns=["class", "n", "prefix", "segments"])

    return run


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common shingles of every left and right set (each without repeats), as a matrix of 32-bit counts.

    Shingles of few sets add their pairs one by one, those of many as products of 0/1 matrices.
    """
    out = np.zeros((len(left), len(right)), np.uint32)
    one, two = np.concatenate(left), np.concatenate(right)
    by_one, by_two = np.argsort(one), np.argsort(two)
    rows = np.repeat(np.arange(len(left)), [len(t) for t in left])[by_one]
    cols = np.repeat(np.arange(len(right)), [len(t) for t in right])[by_two]
    kinds, begin, c = np.unique(one[by_one], return_index=True, return_counts=True)
    other, begin_two, d = np.unique(two[by_two], return_index=True, return_counts=True)
    _, i, j = np.intersect1d(kinds, other, assume_unique=True, return_indices=True)
    begin, c, begin_two, d = begin[i], c[i], begin_two[j], d[j]
    heavy = c * d * 100 > out.size
    for at in np.split(np.flatnonzero(~heavy), np.flatnonzero(np.diff(np.cumsum((c * d)[~heavy]) // STEP_PAIRS)) + 1):
        # every left entry of these shingles meets the d right entries of its shingle
        spread = np.repeat(d[at], c[at])
        x = np.repeat(rows[_ranges(begin[at], c[at])], spread)
        y = cols[_ranges(np.repeat(begin_two[at], c[at]), spread)]
        out += np.bincount(x * len(right) + y, minlength=out.size).reshape(out.shape).astype(np.uint32)
    many = np.flatnonzero(heavy)
    for at in (many[k : k + STEP_TOKENS] for k in range(0, len(many), STEP_TOKENS)):
        a, b = np.zeros((len(left), len(at)), np.float32), np.zeros((len(at), len(right)), np.float32)
        a[rows[_ranges(begin[at], c[at])], np.repeat(np.arange(len(at)), c[at])] = 1
        b[np.repeat(np.arange(len(at)), d[at]), cols[_ranges(begin_two[at], d[at])]] = 1
        out += (a @ b).astype(np.uint32)
    return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ..."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _units(rows: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame, pd.DataFrame]]:
    """(leader, p, q), left and right members in the order of their classes, of each unit in rows."""
    for key, unit in rows.groupby(UNIT, sort=False):
        unit = unit.sort_values("class")
        left = unit[unit["side"] == 0]
        yield key, left, left if key[1] == key[2] else unit[unit["side"] == 1]


def _partial(rows: pd.DataFrame) -> pd.DataFrame:
    """Segments of one pack and fragment -> the matrix of partial overlaps of each unit."""
    out = []
    for (leader, p, q), left, right in _units(rows):
        a = [np.frombuffer(x, "<u8") for x in left["segment"]]
        b = a if right is left else [np.frombuffer(x, "<u8") for x in right["segment"]]
        found = _counts(a, b) if len(a) and len(b) else np.zeros((0, 0), np.uint32)
        if found.any():
            kind = "<u2" if int(found.max()) < 1 << 16 else "<u4"
            out.append((rows["pack"].iloc[0], leader, p, q, rows["fragment"].iloc[0], kind.encode() + found.astype(kind).tobytes()))
    return pd.DataFrame(out, columns=["pack", *UNIT, "fragment", "counts"])


def _earlier(leader: int, left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Whether a left and a right member also meet in a group of a lesser leader."""
    number: dict[int, int] = {}
    sides = []
    for side in (left, right):
        at = [(i, number.setdefault(x, len(number))) for i, own in enumerate(side["leaders"]) for x in own if x < leader]
        sides.append(np.array(at, np.int64).reshape(-1, 2))
    out = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(number), STEP_TOKENS):
        marks = []
        for at, size in zip(sides, out.shape):
            own = at[(at[:, 1] >= lo) & (at[:, 1] < lo + STEP_TOKENS)]
            mark = np.zeros((size, STEP_TOKENS), np.float32)
            mark[own[:, 0], own[:, 1] - lo] = 1
            marks.append(mark)
        out |= marks[0] @ marks[1].T > 0
    return out


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """(least class, other class) for every class of each component of the links between left and right."""
    out = []
    todo = linked.any(1)
    while todo.any():
        rows, cols = np.zeros(len(left), bool), np.zeros(len(right), bool)
        front = np.zeros(len(left), bool)
        front[np.argmax(todo)] = True
        while front.any():
            rows |= front
            cols |= linked[front].any(0)
            front = linked[:, cols].any(1) & ~rows
        todo &= ~rows
        own = np.unique(np.concatenate([left[rows], right[cols]])).tolist()
        out += [(own[0], x) for x in own[1:]]
    return out


def _links(percent: int, every: bool):
    """Members and partial overlaps of one pack -> kind 0: what a unit connects; kind 1: number of
    links of a class in a unit (n); with every, kind 2: each linked pair, sizes and overlap (n)."""

    def run(members: pd.DataFrame, partial: pd.DataFrame) -> pd.DataFrame:
        parts = {key: own["counts"].tolist() for key, own in partial.groupby(UNIT, sort=False)}
        out: list[tuple[int, ...]] = []
        for key, left, right in _units(members):
            if key not in parts:
                continue
            shape = (len(left), len(right))
            total = np.zeros(shape, np.int64)
            for body in parts[key]:
                total += np.frombuffer(body, body[:3].decode(), offset=3).reshape(shape)
            a, b = left["class"].to_numpy(), right["class"].to_numpy()
            na, nb = left["n"].to_numpy(np.int64), right["n"].to_numpy(np.int64)
            linked = 100 * total >= percent * (na[:, None] + nb[None, :] - total)
            if right is left:
                np.fill_diagonal(linked, False)
            out += [(0, x, y, 0, 0, 0) for x, y in _forest(linked, a, b)]
            linked &= ~_earlier(key[0], left, right)
            for classes, n in ((a, linked.sum(1)),) if right is left else ((a, linked.sum(1)), (b, linked.sum(0))):
                out += [(1, x, 0, 0, 0, k) for x, k in zip(classes[n > 0].tolist(), n[n > 0].tolist())]
            if every:
                i, j = np.nonzero(np.triu(linked) if right is left else linked)
                out += zip([2] * len(i), a[i].tolist(), b[j].tolist(), na[i].tolist(), nb[j].tolist(), total[i, j].tolist())
        return pd.DataFrame(out, columns=["kind", "a", "b", "na", "nb", "n"])

    return run


def _numbered(facts: DataFrame) -> tuple[DataFrame, DataFrame, dict[tuple[int, int], int]]:
    """(facts, one row a class, new numbers of the rare sets that share 64 bits of their digest)."""
    moved: dict[tuple[int, int], int] = {}
    while True:
        sets = facts.where("kind = 0 and n > 0")
        classes = sets.groupBy("class").agg(F.min("id").alias("id"), F.min("high").alias("lo"), F.max("high").alias("hi"))
        classes = written(classes, "classes")
        clashes = classes.where("lo <> hi").select("class", "lo")
        if clashes.isEmpty():
            return facts, classes.select("class", "id"), moved
        other = (F.col("kind") == 0) & F.col("lo").isNotNull() & (F.col("high") != F.col("lo"))
        named = facts.join(clashes, "class", "left").withColumn("other", F.when(other, F.xxhash64("class", "high")))
        named = written(named, "shingle-facts")
        old = {new: pair for pair, new in moved.items()}
        for low, high, new in named.where("other is not null").select("class", "high", "other").distinct().collect():
            moved[(old[low][0] if low in old else low, high)] = new
        facts = named.withColumn("class", F.coalesce("other", "class")).drop("other", "lo")


def _members(reduced: DataFrame) -> DataFrame:
    """(leader, class, n), once each, where the group has two classes or more, with the group's blocks."""
    entries = reduced.select("class", "n", F.explode("prefix").alias("token"))
    leads = entries.groupBy("token").agg(F.min("class").alias("leader"), F.max("class").alias("last")).where("leader <> last")
    members = written(entries.join(leads, "token").select("leader", "class", "n").distinct(), "members")
    groups = members.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    least = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    blocks = F.when(least <= 16, least).otherwise(F.greatest(F.lit(16), F.ceil(least / 4))).cast("int")
    return members.join(groups.select("leader", blocks.alias("blocks")), "leader")


def _join(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of all rows, id of each class, what the units found)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    facts, classes, moved = _numbered(written(texts.mapInArrow(_facts(width), FACTS.format(kind=kind)), "shingle-facts"))
    hot = spark.sparkContext.broadcast(hot_shingles(facts))
    total = facts.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    marked, total = _linkable(texts, moved, total, percent, width)
    marked = spark.sparkContext.broadcast(marked)
    owners = max(2, shuffle_width(spark), total // OWNER_ROWS)
    owners = 1 << (owners - 1).bit_length()
    sent = texts.select("text").mapInArrow(_sets(hot, marked, moved, owners, width), SENT)
    back = written(sent.groupBy("owner").applyInPandas(lean_group(_shared(hot, owners)), BACK), "shared-shingles")
    cuts = Cuts(dict(back.where("home is null").groupBy("magnitude").agg(F.sum("entries")).collect()))
    reduced = written(back.where("home is not null").groupBy("home").applyInPandas(lean_group(_reduced(cuts, percent)), REDUCED), "reduced-sets")
    members = written(_members(reduced), "grouped")

    wanted = members.groupBy("class").agg(F.collect_set("leader").alias("leaders"))
    block = F.pmod(F.xxhash64("class", "leader"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "leader", "class", "n", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    load = members.agg(F.sum(F.col("n").cast("long") * F.col("blocks")).alias("tokens"), F.sum(F.lit(BLOCK_ROWS) * F.col("blocks")).alias("pairs")).first()
    packs = max(shuffle_width(spark), (load["tokens"] or 0) // UNIT_TOKENS, (load["pairs"] or 0) // UNIT_PAIRS)
    dealt = written(dealt.withColumn("pack", F.pmod(F.xxhash64(*UNIT), F.lit(packs))), "units")

    segments = reduced.select("class", "segments")
    bodies = dealt.join(segments, "class").select("pack", *UNIT, "side", "class", F.posexplode("segments").alias("fragment", "segment"))
    partial = bodies.groupBy("pack", "fragment").applyInPandas(lean_group(_partial), PARTIAL)
    rows = dealt.join(wanted, "class")
    links = rows.groupBy("pack").cogroup(partial.groupBy("pack")).applyInPandas(lean_pair(_links(percent, every)), OUT)
    return facts, classes, written(links, "links")


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """Every verified pair of classes: id_a, id_b, n_a, n_b, overlap.

    A class is all texts with one set of shingles and goes by its smallest id; equal sets
    are not paired with each other. Sizes and overlap are numbers of shingles, and a pair
    occurs once, with id_a <= id_b. The result has as many rows as there are links.
    """
    _, classes, found = _join(docs, id_col, text_col, percent, width, True)
    links = found.where("kind = 2")
    named = links.join(classes.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(classes.select(F.col("class").alias("b"), F.col("id").alias("y")), "b")
    swap = F.col("x") > F.col("y")
    turned = lambda one, two: F.when(swap, F.col(two)).otherwise(F.col(one))
    return named.select(
        turned("x", "y").alias("id_a"),
        turned("y", "x").alias("id_b"),
        turned("na", "nb").alias("n_a"),
        turned("nb", "na").alias("n_b"),
        F.col("n").alias("overlap"),
    )


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the smallest id reachable by links), n_links.

    A set is the distinct `width`-word shingles of the whole text; texts link when
    100 * intersection >= percent * union. n_links counts the other sets that the row's set
    links with; rows of one set are not counted. Null and empty texts have no set and link
    with nothing. Rows that repeat an id each get a row. A null id is never a component's
    id unless all of its rows have null ids. An empty table gives an empty result.
    """
    facts, classes, found = _join(docs, id_col, text_col, percent, width, False)
    roots = connected_components(found.where("kind = 0").select("a", "b"))
    degrees = found.where("kind = 1").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
    least = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = least.groupBy("root").agg(F.min("id").alias("component_id"))
    named = least.join(names, "root").join(degrees, "class", "left").select("class", F.lit(1).alias("linked"), "component_id", "n_links")
    rows = facts.where("kind = 0").select("id", "n", "class", F.when(F.col("n") > 0, 1).otherwise(0).alias("linked"))
    return rows.join(named, ["class", "linked"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("linked") == 1, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, the one with the smallest id; columns as they were.

    The ids that go (of rows that repeat an id, none stays) meet the texts: up to BROADCAST_IDS without a shuffle of these.
    """
    name = fresh_name(docs, "__af_gone")
    stays = F.max(F.col(id_col).eqNullSafe(F.col("component_id")))
    found = near_duplicate_components(docs, id_col, text_col).groupBy(F.col(id_col).alias(name)).agg(stays.alias("stays"))
    gone = written(found.where("not stays").select(name), "gone-ids")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
