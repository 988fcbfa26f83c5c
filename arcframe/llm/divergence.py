"""Divergence between the sources of each language, by dense tiles of groups and terms.

Terms are counted per (lang, source) over all whole texts; a language keeps the terms of at
least LEAST_DOCS of its documents. Tasks count slices of text in arrays and pack the counts
for the owners of their terms, so that a shuffle moves few large rows. An owner adds up what
it gets, keeps terms, and cuts those of a language into blocks: a row for each group of a block.
A language's groups are numbered and cut into tiles. A task gets about BLOCK terms for two
tiles, lays the counts of a block out as an int64 matrix, and compares all pairs of groups by
broadcasting. Partial sums of a pair are added up; the best terms of a group are merged from
one short list a task.

All numbers are integers: p = 1 + floor(10**9 * (count + 2) / (N + 2 V)) is a long division,
so counts and totals up to 9e15 are exact; differences of p squared stay below 2**63. Terms are
told apart by their bytes; a hash decides only who owns one.

Odd rows: null text, lang or source count as ''; rows that repeat count again; a group without
terms has counts of 0; without kept terms all its pairs are 0; an empty table gives an empty
result; further columns are ignored. Ties rank by the bytes of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcframe.llm.common import lean, run_hashes, shuffle_width, trim, written
from arcframe.operators.layout import dense_ids

#: Whether a term has the byte (ASCII letters and all of letters beyond ASCII), and the byte that it has then.
IN_TERM = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
LEAST_DOCS, TOP_TERMS = 10, 10
#: Terms a block and groups a tile: a task holds 2 * TILE * BLOCK counts at most.
BLOCK, TILE = 2048, 128
#: Bytes of text that are counted at once (or one text); counts and bytes of their terms that a task holds before it hands them on.
SLICE_BYTES, HELD_COUNTS, HELD_BYTES = 2 << 20, 1 << 19, 16 << 20
#: Counts and bytes of their terms that an owner adds up at once.
ROUND_COUNTS, ROUND_BYTES = 1 << 22, 128 << 20

PIECES = "lang string, source string, owner int, counts long, size long, body binary"
FOUND = "lang string, block long, source string, width long, total long, body binary"
PARTIAL = "lang string, part string, one long, two long, item string, value long"


def packed(columns: dict[str, pa.Array]) -> bytes:
    batch, out = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def binary_parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places where the values of a large_binary array begin and end, their bytes)."""
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, body = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return at - at[0], np.frombuffer(body or b"", np.uint8)[at[0] : at[-1]]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys that differ from the one before."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, A-Z lower-cased, and for each the place of its text."""
    at, codes = binary_parts(texts)
    inside = IN_TERM[codes]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(codes)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - starts)]).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[codes[inside]])])
    return terms, np.searchsorted(at, starts, "right") - 1


def counted(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, count, documents) of texts that are in these groups; a term and a group meet once."""
    terms, text = terms_of(texts)
    words = terms.dictionary_encode()
    order = np.argsort(group, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys = words.indices.to_numpy().astype(np.int64) * len(order) + place[text]
    keys.sort()
    at = firsts(keys)
    n, word, own = np.diff(at, append=len(keys)), keys[at] // len(order), group[order[keys[at] % len(order)]]
    both = firsts(word * (int(group.max()) + 1) + own)
    docs = np.diff(both, append=len(at))
    n = np.add.reduceat(n, both) if len(both) else n
    return pa.DictionaryArray.from_arrays(pa.array(word[both], pa.int32()), words.dictionary), own[both], n, docs


def owners_of(words: pa.Array) -> np.ndarray:
    at, codes = binary_parts(words)
    return run_hashes(codes, at[:-1], np.diff(at))


def one_array(chunks: list[pa.Array]) -> pa.DictionaryArray:
    whole = pa.chunked_array(chunks).unify_dictionaries().combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def pieces_of(held: list, names: list[tuple[str, str]], owners: int) -> Iterator[dict]:
    """What a task has counted, added up and packed: a row for each owner that has a term."""
    words = one_array([h[0] for h in held])
    group, n, docs = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    owner = (owners_of(words.dictionary) % np.uint64(owners)).astype(np.int64)
    by_owner = np.argsort(owner, kind="stable")
    place = np.empty(len(owner), np.int64)
    place[by_owner] = np.arange(len(owner))
    terms, owner = words.dictionary.take(pa.array(by_owner)), owner[by_owner]
    keys = place[words.indices.to_numpy()] * len(names) + group
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = firsts(keys)
    keys, n, docs = keys[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)
    word, group = keys // len(names), keys % len(names)
    edges = firsts(owner[word])
    for lo, hi in zip(edges, [*edges[1:], len(word)]):
        first, last = word[lo], word[hi - 1] + 1
        used, own = np.unique(group[lo:hi], return_inverse=True)
        named = lambda i: pa.array([names[g][i] for g in used], pa.string()).take(pa.array(own)).dictionary_encode()
        term = pa.DictionaryArray.from_arrays(pa.array(word[lo:hi] - first, pa.int32()), terms.slice(first, last - first))
        body = packed({"lang": named(0), "source": named(1), "term": term, "n": pa.array(n[lo:hi]), "docs": pa.array(docs[lo:hi])})
        yield {"owner": int(owner[first]), "counts": int(hi - lo), "size": int(np.diff(binary_parts(term.dictionary)[0]).sum()), "body": body}


def term_counts(docs: DataFrame, owners: int, text_col: str = "text") -> DataFrame:
    """(owner, counts, size, body): packed counts; and a row (lang, source) for each group and task."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("owner", pa.int32()), ("counts", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list = []
        counts = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal counts, size
            if counts:
                for row in pieces_of(held, list(names), owners):
                    yield pa.RecordBatch.from_pylist([row], schema)
            held.clear()
            counts = size = 0

        for batch in lean(batches):
            pair = [batch.column(i).dictionary_encode() for i in (0, 1)]
            both = pair[0].indices.to_numpy().astype(np.int64) * len(pair[1].dictionary) + pair[1].indices.to_numpy()
            found, group = np.unique(both, return_inverse=True)
            known = [tuple(p.dictionary[int(k)].as_py() for p, k in zip(pair, divmod(k, len(pair[1].dictionary)))) for k in found]
            group = np.array([names.setdefault(k, len(names)) for k in known], np.int64)[group]
            texts = batch.column(2).cast(pa.large_binary())
            at = binary_parts(texts)[0]
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
                held.append(counted(texts.slice(lo, hi - lo), group[lo:hi]))
                counts, size, lo = counts + len(held[-1][1]), size + int(np.diff(binary_parts(held[-1][0].dictionary)[0]).sum()), hi
                if counts >= HELD_COUNTS or size >= HELD_BYTES:
                    yield from flush()
        yield from flush()
        if names:
            yield pa.RecordBatch.from_pylist([{"lang": lang, "source": source} for lang, source in names], schema)
        trim()

    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in (("lang", "lang"), ("source", "source"), (text_col, "text"))])
    return filled.mapInArrow(run, PIECES)


def kept_counts(pieces: pa.Table, owners: int, block: int) -> Iterator[dict]:
    """An owner's kept terms in blocks of each language: a row for each group that has one of a block's terms."""
    rounds = 1 + max(sum(pieces.column("counts").to_pylist()) // ROUND_COUNTS, sum(pieces.column("size").to_pylist()) // ROUND_BYTES)
    number = pieces.column("owner")[0].as_py() << 32
    for k in range(rounds):
        parts = []
        for body in pieces.column("body"):
            part = unpacked(body.as_py())
            if rounds > 1:
                term = part.column("term").chunk(0)
                own = owners_of(term.dictionary) // np.uint64(owners) % np.uint64(rounds) == k
                part = part.filter(pa.array(own[term.indices.to_numpy()]))
                part = part.set_column(2, "term", part.column("term").cast(pa.large_binary()).dictionary_encode())
            if part.num_rows:
                parts.append(part)
        if not parts:
            continue
        lang, source, term = (one_array([c for p in parts for c in p.column(name).chunks]) for name in ("lang", "source", "term"))
        n, docs = (np.concatenate([p.column(name).to_numpy() for p in parts]) for name in ("n", "docs"))
        del parts
        sources, words = len(source.dictionary), len(term.dictionary)
        keys = (lang.indices.to_numpy().astype(np.int64) * words + term.indices.to_numpy()) * sources + source.indices.to_numpy()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = firsts(keys)
        keys, n, docs = keys[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at)
        at = firsts(keys // sources)
        keep = np.add.reduceat(docs, at) >= LEAST_DOCS
        if not keep.any():
            continue
        # from here on a language's kept terms go by number, in the order of their bytes
        lang_n = np.add.reduceat(n, at)[keep]
        of, word = np.divmod(keys[at][keep] // sources, words)
        rows = np.repeat(keep, np.diff(at, append=len(keys)))
        term_of_row = np.repeat(np.arange(len(of)), np.diff(at, append=len(keys))[keep])
        source_of_row, n = keys[rows] % sources, n[rows]
        term = term.dictionary.take(pa.array(word))
        order = pc.sort_indices(pa.table({"lang": of, "term": term}), sort_keys=[("lang", "ascending"), ("term", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int64)
        of_sorted = of[order]
        heads = firsts(of_sorted)
        sizes = np.diff(heads, append=len(of))
        place[order] = np.arange(len(of)) - np.repeat(heads, sizes)
        size_of = dict(zip(of_sorted[heads].tolist(), sizes.tolist()))
        by = np.lexsort((place[term_of_row], source_of_row, place[term_of_row] // block, of[term_of_row]))
        term_of_row, source_of_row, n = term_of_row[by], source_of_row[by], n[by]
        col, part_of_row, lang_of_row = place[term_of_row] % block, place[term_of_row] // block, of[term_of_row]
        edges = np.flatnonzero(np.concatenate([[True], np.any([np.diff(x) != 0 for x in (lang_of_row, part_of_row, source_of_row)], axis=0)]))
        numbers: dict[tuple[int, int], int] = {}
        for lo, hi in zip(edges, [*edges[1:], len(n)]):
            which, part = int(lang_of_row[lo]), int(part_of_row[lo])
            if (which, part) not in numbers:
                numbers[which, part] = number
                number += 1
            own = term_of_row[lo:hi]
            body = packed({"col": pa.array(col[lo:hi], pa.int32()), "term": term.take(pa.array(own)), "n": pa.array(n[lo:hi]), "lang_n": pa.array(lang_n[own])})
            yield {"lang": lang.dictionary[which].as_py(), "block": numbers[which, part], "source": source.dictionary[int(source_of_row[lo])].as_py(), "width": min(block, size_of[which] - part * block), "total": int(n[lo:hi].sum()), "body": body}


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 2) / (totals + 2 * kept)), three digits at a time."""
    whole = np.asarray(totals, np.int64) + 2 * kept
    rest = counts + 2
    out = np.zeros(np.broadcast(rest, whole).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return 1 + out


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)

def compare(rows: pa.Table, tile: int) -> pa.Table:
    """Partial pair sums and best terms of a few blocks of terms and one or two tiles of groups.

    All terms of a block are columns, those that no group here has too; one block at a time is laid out.
    """
    lang, tile_one, tile_two, kept, lang_total = (rows.column(c)[0].as_py() for c in ("lang", "tile_one", "tile_two", "kept", "lang_total"))
    gid, which = np.unique(rows.column("gid").to_numpy(), return_inverse=True)
    totals = np.zeros(len(gid), np.int64)
    totals[which] = rows.column("total").to_numpy()
    in_one, in_two = np.flatnonzero(gid // tile == tile_one), gid // tile == tile_two
    others = {i: np.flatnonzero(in_two & (gid > gid[i])) for i in in_one}
    sums = {i: np.zeros(len(x), np.int64) for i, x in others.items()}
    best: list[list[tuple[int, bytes]]] = [[] for _ in gid]

    blocks = rows.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    for places in np.split(order, firsts(blocks[order])[1:]):
        width = rows.column("width")[int(places[0])].as_py()
        n = np.zeros((len(gid), width), np.int64)
        for j in places:
            if (body := rows.column("body")[int(j)].as_py()) is None:
                continue
            i, own = which[j], unpacked(body)
            own_n = own.column("n").to_numpy()
            n[i, own.column("col").to_numpy()] = own_n
            if tile_one == tile_two:
                p, q = shares(own_n, totals[i], kept), shares(own.column("lang_n").to_numpy(), np.int64(lang_total), kept)
                more = np.flatnonzero(p > q)
                value = gaps(p[more], q[more])
                top = np.argsort(-value, kind="stable")[:TOP_TERMS]  # terms of a block are in the order of their bytes
                found = zip((-value[top]).tolist(), own.column("term").take(pa.array(more[top])).to_pylist())
                best[i] = sorted([*best[i], *found])[:TOP_TERMS]
        if width:
            p = shares(n, totals[:, None], kept)
            for i, x in others.items():
                sums[i] += gaps(p[i], p[x]).sum(axis=1)
    trim()

    made = [(lang, "pair", int(gid[i]), two, None, value) for i, x in others.items() for two, value in zip(gid[x].tolist(), sums[i].tolist())]
    made += [(lang, "term", one, None, term.decode(), -value) for one, own in zip(gid.tolist(), best) for value, term in own]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.table([pa.array([row[k] for row in made], kind) for k, kind in enumerate(kinds)], names=["lang", "part", "one", "two", "item", "value"])


def _numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 within each lang, in the order of by."""
    ids = dense_ids(df, by, "__id")
    first = ids.groupBy("lang").agg(F.min("__id").alias("__first"))
    return ids.join(first, "lang").withColumn(name, F.col("__id") - F.col("__first")).drop("__id", "__first")


def divergence(docs: DataFrame, text_col: str = "text", block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, and the terms that mark a source."""
    owners = shuffle_width(docs.sparkSession)
    pieces = written(term_counts(docs, owners, text_col), "terms")
    groups = written(_numbered(pieces.where("owner is null").select("lang", "source").distinct(), ["lang", "source"], "gid"), "groups")
    schema = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("width", pa.int64()), ("total", pa.int64()), ("body", pa.binary())])

    def keep(rows: pa.Table) -> pa.Table:
        made = pa.Table.from_pylist(list(kept_counts(rows, owners, block)), schema)
        trim()
        return made

    found = pieces.where("owner is not null").select("owner", "counts", "size", "body").groupBy("owner").applyInArrow(keep, FOUND)
    found = written(found, "counts")

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    blocks = found.select("lang", "block", "width").distinct()
    langs = blocks.groupBy("lang").agg(F.sum("width").alias("kept")).join(found.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang")
    totals = found.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    sized = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", "gid", zero("total"), zero("kept"), zero("lang_total"))
    tiles = groups.groupBy("lang").agg((F.floor(F.max("gid") / tile) + 1).alias("tiles"))
    # a language without kept terms has one block of none
    spread = sized.join(blocks, "lang", "left").select("lang", "source", "gid", "total", "kept", "lang_total", zero("block"), zero("width"))
    spread = spread.join(found.select("lang", "block", "source", "body"), ["lang", "block", "source"], "left").join(tiles, "lang")
    # each row once for every pair of tiles that its own is in
    own_tile = F.floor(F.col("gid") / tile)
    dealt = spread.withColumn("tile", own_tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    # blocks of many owners can be small: as many as fill one go together, or else each has sums of all pairs
    bundle = F.pmod(F.xxhash64("block"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("kept") / block))).alias("bundle")
    dealt = dealt.select("lang", bundle, "block", "gid", "total", "kept", "lang_total", "width", "body", F.least("tile", "other").alias("tile_one"), F.greatest("tile", "other").alias("tile_two"))
    partial = written(dealt.groupBy("lang", "bundle", "tile_one", "tile_two").applyInArrow(lambda rows: compare(rows, tile), PARTIAL), "partial")

    names = groups.select("lang", "gid", "source")
    sums = partial.where("part = 'pair'").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("one").alias("gid"), F.col("two").alias("other")), F.struct(F.col("two").alias("gid"), F.col("one").alias("other"))))
    pairs = sums.select("lang", "value", sides.alias("x")).select("lang", "x.*", "value").join(names, ["lang", "gid"])
    pairs = pairs.join(names.select("lang", F.col("gid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    ranked = lambda order: F.row_number().over(Window.partitionBy("lang", "gid").orderBy(F.desc("value"), order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", ranked("item")).select(columns)

    best = partial.where("part = 'term'").select("lang", F.col("one").alias("gid"), "item", "value")
    best = best.withColumn("rank", ranked("item")).where(F.col("rank") <= TOP_TERMS)
    terms = best.join(names, ["lang", "gid"])
    return pairs.unionByName(terms.withColumn("part", F.lit("term")).select(columns))
