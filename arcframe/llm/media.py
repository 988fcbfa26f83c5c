"""Media columns with content-defined payload chunking.

A payload is stored as an 8-bit greyscale image (binary PGM, 192 samples a row). A rolling
gear hash cuts the stored bytes into chunks, so a passage that media share gives equal
chunks wherever it stands.

1. Manifest: per media the ordered chunk digests and sizes; no bytes move. Digests are the
   first DIGEST bytes of SHA-256.
2. One owner is picked per digest (and one row per media); an owner's list of ordinals follows
   from the digests it is first for, so media and digests meet once.
3. Owners append their chunks to pack files in the shared folder, BLOCK bytes of chunks in a
   zstd frame: small chunks share passages of a few hundred bytes and still pack well. Only
   the lists of media that own less than all of their chunks are joined to the texts, by
   broadcast while they are small.
4. Reading: ordered lists meet the chunks' places in a join of small rows, sorted by place;
   tasks read the frames, rebuild the media and verify digest and size of every chunk and
   of the whole. Features are computed from the rebuilt samples.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcframe.llm.common import mix64, new_folder, shuffle_width, written
from arcframe.llm.fragments import slices
from arcframe.llm.shared_files import Appender, RangeReader

ROW = 192
#: Chunk sizes in bytes; the mean lies near LEAST + 2 ** CUT_BITS.
LEAST, MOST, CUT_BITS = 256, 4096, 9
#: Bytes of a digest, of the chunks in a frame, and frames that a reader holds unpacked.
DIGEST, BLOCK, FRAMES = 16, 1 << 15, 64
WINDOW = 32
GEAR = (mix64(np.arange(5001, 5257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
BROADCAST_ROWS = 200_000

MANIFEST = "id {kind}, media binary, media_bytes long, n_bytes long, key long, digests array<binary>, sizes array<int>"
PLACES = "digest binary, size int, pack string, at long, packed int, within int"
REBUILT = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_form(text: bytes) -> bytes:
    """text padded with spaces to a positive multiple of ROW, as a binary PGM image."""
    rows = max(1, -(-len(text) // ROW))
    return b"P5\n%d %d\n255\n%s%s" % (ROW, rows, text, b" " * (rows * ROW - len(text)))


def samples(image: bytes) -> bytes:
    """The samples of a binary PGM image with one byte a sample."""
    magic, size, most, rest = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(rest) != width * height:
        raise ValueError("not an 8-bit PGM image")
    return rest


def gear_marks(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the top CUT_BITS of the gear hash are zero.

    h[i] = sum of GEAR[data[i - j]] << j over WINDOW bytes, by doubling.
    """
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def cut_points(marks: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of data[begin:end]; marks are ascending positions."""
    out, at = [], begin
    while end - at > LEAST:
        i = np.searchsorted(marks, at + LEAST)
        stop = int(min(marks[i] if i < len(marks) else end, at + MOST, end))
        out.append(stop)
        at = stop
    if at < end:
        out.append(end)
    return out


def chunked(texts: list[bytes]) -> Iterator[tuple[bytes, list[bytes]]]:
    """(stored form, its chunks) of each text.

    Texts are hashed side by side: a cut lies LEAST bytes or more behind the begin of its
    media, so the window of its hash holds bytes of that media only.
    """
    images = [stored_form(t) for t in texts]
    marks = gear_marks(np.frombuffer(b"".join(images), np.uint8)) if images else np.zeros(0, np.int64)
    base = 0
    for image in images:
        ends = cut_points(marks, base, base + len(image))
        yield image, [image[a - base : b - base] for a, b in zip([base, *ends[:-1]], ends)]
        base += len(image)


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            texts = _bytes(batch.column(1).slice(lo, hi - lo))
            rows = [(_digest(image), len(image), len(t), [_digest(c) for c in chunks], [len(c) for c in chunks]) for t, (image, chunks) in zip(texts, chunked(texts))]
            media, media_bytes, n_bytes, digests, sizes = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(media, pa.binary()),
                    pa.array(media_bytes, pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                    batch.column(2).slice(lo, hi - lo),
                    pa.array(digests, pa.list_(pa.binary())),
                    pa.array(sizes, pa.list_(pa.int32())),
                ],
                names=["id", "media", "media_bytes", "n_bytes", "key", "digests", "sizes"],
            )


def _packer(folder: str):
    """(text, owned ordinals or null for all) -> places of the chunks written, a frame of chunks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, pack = zstandard.ZstdCompressor(level=3), Appender(folder, "pack", ".chunks")
        held, within = [], 0

        def flush() -> pa.RecordBatch:
            body = press.compress(b"".join(held))
            at, begins = pack.append(body), np.cumsum([0, *map(len, held[:-1])])
            n = len(held)
            columns = ([_digest(c) for c in held], [len(c) for c in held], [pack.name] * n, [at] * n, [len(body)] * n, begins)
            kinds = (pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["digest", "size", "pack", "at", "packed", "within"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                texts = _bytes(batch.column(0).slice(lo, hi - lo))
                owned = batch.column(1).slice(lo, hi - lo).to_pylist()
                for mine, (_, chunks) in zip(owned, chunked(texts)):
                    for i in range(len(chunks)) if mine is None else mine:
                        held.append(chunks[i])
                        within += len(chunks[i])
                        if within >= BLOCK:
                            yield flush()
                            within = 0
        if held:
            yield flush()
        pack.close()

    return run


def feature(payload: bytes) -> str:
    """Rows, sum and sum of squares of the samples, and the bits of their 16-bin histogram above its mean."""
    data = np.frombuffer(payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    levels = np.arange(256)
    bins = counts.reshape(16, 16).sum(1)
    bits = sum(1 << i for i in range(16) if 16 * int(bins[i]) > len(data))
    return f"rows={len(data) // ROW};sum={int(counts @ levels)};squares={int(counts @ (levels * levels))};bins={bits:04x}"


def _rebuilder(folder: str):
    """(media digest, its chunks in order with their places) -> facts of the verified media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard

        unpress, reader = zstandard.ZstdDecompressor(), RangeReader(folder)
        frames: OrderedDict[tuple[str, int], bytes] = OrderedDict()

        def frame(p: dict) -> bytes:
            place = p["pack"], p["at"]
            if place not in frames:
                frames[place] = unpress.decompress(reader.read(*place, p["packed"]))
                if len(frames) > FRAMES:
                    frames.popitem(last=False)
            frames.move_to_end(place)
            return frames[place]

        for batch in batches:
            rows = []
            for media, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunks = []
                for p in parts:
                    chunk = frame(p)[p["within"] : p["within"] + p["size"]]
                    if len(chunk) != p["size"] or _digest(chunk) != p["digest"]:
                        raise ValueError(f"chunk {p['digest'].hex()} is damaged in {p['pack']}")
                    chunks.append(chunk)
                image = b"".join(chunks)
                whole = hashlib.sha256(image)
                if whole.digest()[:DIGEST] != media:
                    raise ValueError(f"media {media.hex()} is not what was stored")
                payload = samples(image)
                rows.append((media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), whole.hexdigest(), feature(payload)))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        reader.close()

    return run


def _ownership(manifest: DataFrame) -> DataFrame:
    """(key, owner, owned) of the media that do not own all of their chunks or have copies."""
    lists = manifest.groupBy("media").agg(F.any_value("digests").alias("digests"))
    spread = lists.select("media", F.posexplode("digests").alias("ordinal", "digest"))
    first = spread.groupBy("digest").agg(F.min(F.struct("media", "ordinal")).alias("first"))
    own = first.groupBy(F.col("first.media").alias("media")).agg(F.sort_array(F.collect_list("first.ordinal")).alias("owned"))
    single = manifest.groupBy("media").agg(F.min("id").alias("owner"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.max(F.size("digests")).alias("chunks"))
    found = single.join(own, "media", "left").withColumn("owned", F.coalesce("owned", F.array().cast("array<int>")))
    return found.where((F.col("copies") > 1) | (F.size("owned") < F.col("chunks"))).select("key", "owner", "owned")


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the chunks of every text's stored form below folder: (manifest, places).

    Each digest is written once, by the row with the smallest id of the media that owns it;
    rows that repeat that id and text write it again and only one place is read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    manifest = written(texts.mapInArrow(_manifest, MANIFEST.format(kind=kind)), "media-manifest")
    partial = written(_ownership(manifest), "media-owners")
    side = F.broadcast(partial) if partial.count() <= BROADCAST_ROWS else partial
    chosen = texts.join(side, "key", "left")
    mine = F.when(F.col("owned").isNull(), F.lit(None)).when(F.col("id").eqNullSafe(F.col("owner")), F.col("owned")).otherwise(F.array().cast("array<int>"))
    places = written(chosen.select("text", mine.alias("owned")).mapInArrow(_packer(folder), PLACES), "media-places")
    return manifest, places


def read_media(manifest: DataFrame, places: DataFrame, folder: str) -> DataFrame:
    """Facts of each distinct media, rebuilt from its ordered chunks and verified (REBUILT)."""
    width = shuffle_width(manifest.sparkSession)
    place = places.groupBy("digest", "size").agg(F.min(F.struct("pack", "at", "packed", "within")).alias("place"))
    single = manifest.groupBy("media").agg(F.any_value("digests").alias("digests"), F.any_value("sizes").alias("sizes"))
    wanted = single.select("media", F.posexplode(F.arrays_zip("digests", "sizes")).alias("ordinal", "chunk")).select(
        "media", "ordinal", F.col("chunk.digests").alias("digest"), F.col("chunk.sizes").alias("size")
    )
    parts = wanted.join(place, ["digest", "size"]).groupBy("media").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "digest", "size", "place.pack", "place.at", "place.packed", "place.within"))).alias("parts")
    )
    begin = [F.col("parts")[0][c] for c in ("pack", "at", "within")]
    near = parts.repartitionByRange(width, *begin[:2]).sortWithinPartitions(*begin)
    return near.select("media", "parts").mapInArrow(_rebuilder(folder), REBUILT)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media, reads it back: id, n_bytes and the facts of the rebuilt media.

    A null text counts as empty and is stored as one row of spaces. Equal texts share their
    media and all facts. Repeated and null ids stay. An empty table gives an empty result.
    """
    folder = new_folder(docs.sparkSession, "media")
    manifest, places = store_media(docs, folder, id_col, text_col)
    facts = read_media(manifest, places, folder)
    return manifest.select("id", "n_bytes", "media", "media_bytes").join(facts, ["media", "media_bytes"]).select(
        F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
