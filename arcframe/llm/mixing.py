"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into (source, lang, topic) cells and raked until the shares of every
margin meet their targets. A document is kept with the calibrated probability of its cell,
decided by a hash of its id, so the expected tokens of every margin are in proportion to
the targets (but for what the caller lets cells fall short, see SHORT).

Topics are clusters of word use, fitted on all texts and given to every row, or a
column of the caller's. Only the cell table is raked: cells are summed map-side before any shuffle. A
table of counted, bounded size is swept by one task; of a larger one each sweep is a window per
margin, and every SWEEPS sweeps are cut by checkpoint().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcframe.llm.common import lean, mix64, run_hashes, shared_dir, written
from arcframe.llm.fragments import WHITE, slices
from arcframe.llm.shingles import LOWER

MARGINS = ("source", "lang", "topic")
TOPICS = 8
#: Words are counted in so many places by hash; words of fewer bytes, and places of more than this share of the texts, are left out.
PLACES, WORD_BYTES, COMMON_SHARE = 2_048, 4, 0.5
#: Rounds of k-means at most; it ends where a round makes texts less than GAIN more like their centers.
ROUNDS, GAIN = 25, 1e-4
#: Parts of a unit vector's length; a text that lacks less of a center counts as equal to it.
UNIT, LACK = 65_535, 1e-3
TOLERANCE = 1e-3
#: Sweeps between two looks at the gaps; raking ends where these no longer narrow the widest gap by this share.
SWEEPS, PROGRESS = 4, 0.05
#: Cells up to this number are raked by one task in memory; beyond it each sweep is a window per margin.
RAKE_CELLS, MOST_SWEEPS = 200_000, 20_000
#: Default targets: token shares to this power, so small sources gain and large ones lose.
POWER = 0.85
#: What sample_mixture lets cells that are wanted more than all others fall short of their share, as a part of the
#: mixture: they are kept whole, and a tiny cell does not set the rate of everything else. mixture() is exact.
SHORT = 0.02
#: Cells up to this number are broadcast to documents; beyond it they are joined by key.
BROADCAST_CELLS = 50_000


def word_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, begin and size of each word, its row) of a non-null Arrow string column.

    A word is a run without [\\x20\\x09-\\x0D].
    """
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base = int(offsets[0])
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[base : int(offsets[-1])]
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    solid = ~white[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets - base] = True
    begins = np.flatnonzero(solid & (np.append(True, ~solid[:-1])[: len(solid)] | edges[:-1]))
    ends = np.flatnonzero(solid & (np.append(~solid[1:], True)[: len(solid)] | edges[1:])) + 1
    return LOWER[data], begins, ends - begins, np.searchsorted(offsets - base, begins, "right") - 1


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text; row, place and log-scaled count of each place where a text has long words, in order)."""
    data, begins, sizes, owner = word_runs(column)
    long = sizes >= WORD_BYTES
    place = (run_hashes(data, begins[long], sizes[long]) % np.uint64(PLACES)).astype(np.int64)
    counts = np.bincount(owner[long] * PLACES + place, minlength=len(column) * PLACES)
    at = np.flatnonzero(counts)
    return np.bincount(owner, minlength=len(column)).astype(np.int64), at // PLACES, at % PLACES, np.log1p(counts[at].astype(np.float32))


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, log-scaled counts of long words by place) of each text."""
    words, row, place, logs = word_places(column)
    counts = np.zeros((len(column), PLACES), np.float32)
    counts[row, place] = logs
    return words, counts


def _portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with bounded text and bounded counts."""
    for lo, hi in slices(column):
        yield from ((k, min(hi, k + 512)) for k in range(lo, hi, 512))


class Topics:
    """Clusters of word use: centers over places, and the weight of each place by its rarity."""

    def __init__(self, weight: np.ndarray, centers: np.ndarray):
        self.weight, self.centers = weight, centers

    def of(self, n: int, row: np.ndarray, place: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The nearest center of each of n texts (see word_places), the first on ties; 0 without words that tell."""
        out = np.zeros(n, np.int32)
        kept, sizes, places, values = _scaled(n, row, place, logs, self.weight)
        if len(kept) and len(self.centers):
            out[kept] = _likeness(sizes, places, values, self.centers).argmax(1)
        return out


def _scaled(n: int, row: np.ndarray, place: np.ndarray, logs: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows with words that tell, number of places of each, places, values): unit vectors in steps of 1 / UNIT.

    Values are whole numbers, so sums over texts are exact and the same in any order.
    """
    value = logs.astype(np.float64) * weight[place]
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = np.rint(UNIT * value / np.maximum(norm[row], 1e-9)).astype("<u2")
    told = value > 0
    sizes = np.bincount(row[told], minlength=n)
    kept = np.flatnonzero(sizes)
    return kept, sizes[kept].astype("<u4"), place[told].astype("<u2"), value[told]


def _likeness(sizes: np.ndarray, places: np.ndarray, values: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Cosines of scaled texts to the centers; each depends on its text and center alone, not on its neighbours."""
    row, value = np.repeat(np.arange(len(sizes)), sizes), values.astype(np.float64) / UNIT
    return np.stack([np.bincount(row, value * center[places], len(sizes)) for center in centers], 1)


def _unit(sums: np.ndarray) -> np.ndarray:
    return sums / np.maximum(np.linalg.norm(sums.astype(np.float64)), 1e-9)


#: A pass over texts gives per partition some vectors of whole numbers by key, which are added up.
SUMS, BLOCKS = "key int, body binary", "key int, body binary, sizes binary, places binary, logs binary"


def _sums(df: DataFrame) -> dict[int, np.ndarray]:
    """The sum of the vectors of each key; a few keys, one vector each reaches the driver."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(body, "<i8") for body in rows["body"])
        return pd.DataFrame({"key": rows["key"].iloc[:1], "body": [total.tobytes()]})

    found = df.select("key", "body").groupBy("key").applyInPandas(add, SUMS).collect()
    return {r["key"]: np.frombuffer(r["body"], "<i8") for r in found}


def _block(batch: pa.RecordBatch, i: int, logs: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("sizes", "<u4"), ("places", "<u2"), ("logs", logs)))


def _blocks(docs: DataFrame, text_col: str) -> DataFrame:
    """Key 0: places and logs of up to 512 texts with words; key 1: per partition, texts by place and at the end all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(PLACES + 1, np.int64)
        for batch in lean(batches):
            for lo, hi in _portions(batch.column(0)):
                _, row, place, logs = word_places(batch.column(0).slice(lo, hi - lo))
                held += np.append(np.bincount(place, minlength=PLACES), hi - lo)
                sizes = np.bincount(row, minlength=hi - lo)
                bodies = [sizes[sizes > 0].astype("<u4"), place.astype("<u2"), logs.astype("<f4")]
                yield pa.RecordBatch.from_pylist([{"key": 0, "body": None, **{c: x.tobytes() for c, x in zip(("sizes", "places", "logs"), bodies)}}], kinds)
        yield pa.RecordBatch.from_pylist([{"key": 1, "body": held.tobytes()}], kinds)

    kinds = pa.schema([("key", pa.int32()), *((c, pa.binary()) for c in ("body", "sizes", "places", "logs"))])
    return written(docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").mapInArrow(run, BLOCKS), "word-places")


def _rescaled(blocks: DataFrame, weight: np.ndarray) -> DataFrame:
    """The blocks as unit vectors in steps of 1 / UNIT (logs: these values); texts without words that tell are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for i in range(batch.num_rows):
                sizes, place, logs = _block(batch, i, "<f4")
                _, sizes, place, values = _scaled(len(sizes), np.repeat(np.arange(len(sizes)), sizes), place, logs, weight)
                if len(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sizes, place, values)], names=["sizes", "places", "logs"])

    whole = blocks.where("key = 0").select("sizes", "places", "logs")
    return written(whole.mapInArrow(run, whole.schema), "topic-rows")


def _next_center(rows: DataFrame, centers: np.ndarray) -> np.ndarray | None:
    """One text of all, drawn in proportion to what it lacks of the nearest center (k-means++); None if none lacks anything.

    The text with the least -log(u) / lack is drawn, u being a hash of its vector and the
    number of centers: equal vectors are one, and the order of rows plays no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in lean(batches):
            for i in range(batch.num_rows):
                sizes, places, values = _block(batch, i, "<u2")
                begin = np.cumsum(sizes.astype(np.int64)) - sizes
                lack = 1 - _likeness(sizes, places, values, centers).max(1) if len(centers) else np.ones(len(sizes))
                own = np.add.reduceat(mix64(places.astype(np.uint64) << np.uint64(16) | values), begin)
                own = mix64(own + np.uint64(len(centers) + 1))
                clock = np.where(lack > LACK, -np.log((own + 1.0) / 2.0**64) / np.maximum(lack, LACK), np.inf)
                k = int(np.lexsort((own, clock))[0])
                if clock[k] < np.inf and (best is None or (clock[k], own[k]) < best[:2]):
                    at = slice(begin[k], begin[k] + sizes[k])
                    best = (clock[k], own[k], places[at].tobytes(), values[at].tobytes())
        if best is not None:
            yield pa.RecordBatch.from_pylist([{"clock": float(best[0]), "own": int(best[1].view(np.int64)), "places": best[2], "logs": best[3]}])

    first = rows.mapInArrow(run, "clock double, own long, places binary, logs binary").orderBy("clock", "own").first()
    if first is None:
        return None
    center = np.zeros(PLACES)
    center[np.frombuffer(first["places"], "<u2")] = np.frombuffer(first["logs"], "<u2")
    return _unit(center)


def _round(rows: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, int]:
    """One round of k-means over all rows: the new centers, and how like all texts were to the old ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, like = np.zeros((len(centers), PLACES), np.int64), 0
        for batch in lean(batches):
            for i in range(batch.num_rows):
                sizes, places, values = _block(batch, i, "<u2")
                found = _likeness(sizes, places, values, centers)
                own = found.argmax(1)
                like += int(np.rint(found.max(1) * UNIT).sum())
                at = np.repeat(own, sizes) * PLACES + places
                sums += np.bincount(at, values, sums.size).astype(np.int64).reshape(sums.shape)
        bodies = [*(x.tobytes() for x in sums), np.array([like], "<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int32()), pa.array(bodies, pa.binary())], names=["key", "body"])

    found = _sums(rows.mapInArrow(run, SUMS))
    return np.stack([_unit(found[k]) if found[k].any() else centers[k] for k in range(len(centers))]), int(found[len(centers)][0])


def fit_topics(docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> Topics:
    """Spherical k-means over all texts, each row once; rarity is counted over all of them too.

    The texts' places are written once and every round reads them all: ROUNDS rounds, or
    until texts are no longer more like their centers (GAIN). The driver holds the centers.
    """
    blocks = _blocks(docs, text_col)
    counted = _sums(blocks.where("key = 1"))
    held = counted.get(1, np.zeros(PLACES + 1, np.int64))
    held, n = held[:-1], int(held[-1])
    weight = np.where((held > 0) & (held <= COMMON_SHARE * n), np.log((1 + n) / (1 + held)), 0.0)
    rows = _rescaled(blocks, weight)
    centers = np.zeros((0, PLACES))
    while len(centers) < topics and (center := _next_center(rows, centers)) is not None:
        centers = np.vstack([centers, center])
    before = 0
    for _ in range(ROUNDS if len(centers) else 0):
        centers, like = _round(rows, centers)
        if like <= before * (1 + GAIN):
            break
        before = like
    return Topics(weight, centers)


def with_features(docs: DataFrame, text_col: str = "text", topic_col: str | None = None, topics: Topics | None = None) -> DataFrame:
    """(tokens, topic, row): row is a struct of all columns of docs; a null text has 0 tokens.

    The topic is the one of topic_col, as a string, or else that of topics.
    """
    own = F.lit(None) if topic_col is None else F.col(f"`{topic_col}`")
    packed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("__af_text"), own.cast("string").alias("__af_topic"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = packed.select(F.lit(0).cast("long").alias("tokens"), F.lit("").alias("topic"), "row").schema
    model = None if topics is None else docs.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for lo, hi in _portions(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                if model is None:
                    _, begins, _, owner = word_runs(part.column(0))
                    words, topic = np.bincount(owner, minlength=hi - lo).astype(np.int64), part.column(1)
                else:
                    words, *places = word_places(part.column(0))
                    topic = pa.array(model.value.of(hi - lo, *places).astype(str))
                yield pa.RecordBatch.from_arrays([pa.array(words), topic, part.column(2)], names=["tokens", "topic", "row"])

    return packed.mapInArrow(run, schema)


def flattened(cells: DataFrame, margin: str, power: float = POWER) -> DataFrame:
    """Targets (margin, target): token shares to the power."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """cells (margin columns, tokens) with share, their part of the mixture (1 in all), and margin_gap.

    targets: per margin a DataFrame (margin, target), scaled to the values that occur with
    tokens. A value without a positive target gets share 0. Sweeps go on until no margin was
    further than tolerance from its target, or the widest gap no longer shrinks: targets that
    no mixture of the cells meets. margin_gap is that gap, as a share of the target.
    """
    shared_dir(cells.sparkSession)
    now = cells.withColumn("share", F.col("tokens").cast("double"))
    for m in targets:
        own = targets[m].select(F.col(m).alias(f"__af_{m}"), F.col("target").cast("double").alias(f"__af_goal_{m}"))
        now = now.join(own, F.col(m).eqNullSafe(F.col(f"__af_{m}")), "left").drop(f"__af_{m}")
        wanted = F.coalesce(F.col(f"__af_goal_{m}") > 0, F.lit(False))
        now = now.withColumn("share", F.when(wanted, F.col("share")).otherwise(0.0))
    now = now.checkpoint()
    for m in targets:
        present = now.where("share > 0").select(F.col(f"__af_goal_{m}").alias("goal"), m).distinct()
        total = present.agg(F.sum("goal")).first()[0] or 1.0
        now = now.withColumn(f"__af_goal_{m}", F.col(f"__af_goal_{m}") / total)
    if now.count() <= RAKE_CELLS:
        kept = [f for f in now.schema.fieldNames() if not f.startswith("__af_goal_")]
        kinds = ", ".join(f"`{f}` {now.schema[f].dataType.simpleString()}" for f in kept)
        return written(now.repartition(1).mapInPandas(_sweeps(tuple(targets), kept, tolerance), f"{kinds}, margin_gap double"), "raked")
    last = None
    while True:
        gaps = [f"__af_gap_{m}" for m in targets]
        for _ in range(SWEEPS):
            for m, gap in zip(targets, gaps):
                held = F.sum("share").over(Window.partitionBy(m))
                now = now.withColumn("__af_factor", F.when(held > 0, F.col(f"__af_goal_{m}") / held))
                now = now.withColumn(gap, F.when(F.col("share") > 0, F.abs(F.col("__af_factor") - 1)))
                now = now.withColumn("share", F.when(F.col("share") > 0, F.col("share") * F.col("__af_factor")).otherwise(0.0)).drop("__af_factor")
        now = now.checkpoint()
        widest = now.agg(F.max(F.greatest(*gaps)) if len(gaps) > 1 else F.max(gaps[0])).first()[0]
        now = now.drop(*gaps)
        if widest is None or widest < tolerance or (last is not None and widest > last * (1 - PROGRESS)):
            break
        last = widest
    return now.drop(*[f"__af_goal_{m}" for m in targets]).withColumn("margin_gap", F.lit(widest).cast("double"))


def _sweeps(margins: tuple[str, ...], kept: list[str], tolerance: float):
    """Sweeps over a bounded table of cells, until the gap is below tolerance or no longer narrows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        cells = pd.concat(parts, ignore_index=True)
        share, live = cells["share"].to_numpy(float), cells["share"].to_numpy() > 0
        codes = [pd.factorize(cells[m], use_na_sentinel=False)[0] for m in margins]
        goals = [cells[f"__af_goal_{m}"].to_numpy(float) for m in margins]
        widest, before = 0.0 if live.any() else None, np.inf
        for sweep in range(MOST_SWEEPS if live.any() else 0):
            widest = 0.0
            for code, goal in zip(codes, goals):
                factor = goal[live] / np.bincount(code, share)[code[live]]
                widest = max(widest, float(np.abs(factor - 1).max()))
                share[live] *= factor
            if widest < tolerance:
                break
            if sweep % 200 == 199:
                if widest > before * (1 - 1e-3):
                    break
                before = widest
        yield cells.assign(share=share, margin_gap=widest)[[*kept, "margin_gap"]]

    return run


def rates(cells: DataFrame, targets: dict[str, DataFrame] | None = None, short: float = 0.0) -> DataFrame:
    """cells with share, margin_gap and keep_rate: the share wanted of a cell for its tokens, scaled, 1 at most.

    The scale keeps whole the cells that are wanted most for their size, up to the part
    `short` of the mixture; with 0 only the first of them. It is read from sums of shares by
    powers of the ratio (a sixteenth of a doubling each), a few hundred rows at any input.
    """
    raked = rake(cells, targets or {m: flattened(cells, m) for m in MARGINS})
    wanted = raked.withColumn("__af_ratio", F.when(F.col("tokens") > 0, F.col("share") / F.col("tokens")).otherwise(0.0))
    step = F.floor(16 * F.log2("__af_ratio"))
    sums = wanted.where("__af_ratio > 0").groupBy(step.alias("step")).agg(F.sum("share").alias("share"), F.max("__af_ratio").alias("most")).orderBy(F.desc("step")).collect()
    most, left = 1.0, short
    for row in sums:
        most, left = row["most"], left - row["share"]
        if left < 0:
            break
    return wanted.withColumn("keep_rate", F.least(F.lit(1.0), F.col("__af_ratio") / F.lit(most))).drop("__af_ratio")


def _chance(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on seed and key only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def _joined(rows: DataFrame, cells: DataFrame) -> DataFrame:
    side = cells.select(*[F.col(m).alias(f"__af_{m}") for m in MARGINS], "share", "keep_rate", "margin_gap")
    if cells.count() <= BROADCAST_CELLS:
        side = F.broadcast(side)
    match = [F.col(m).eqNullSafe(F.col(f"__af_{m}")) for m in MARGINS]
    return rows.join(side, match[0] & match[1] & match[2]).drop(*[f"__af_{m}" for m in MARGINS])


def _cells(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "cells")


def _model(docs: DataFrame, topic_col: str | None) -> Topics | None:
    return fit_topics(docs) if topic_col is None else None


def mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 17, topic_col: str | None = None, short: float = 0.0) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, cell_share, keep_rate, sampled, margin_gap.

    topic_col names a column of docs with topics; without it they are clusters of word use,
    fitted on all texts and given to every row (fit_topics). Null sources and languages are values of their own. Texts without words have no tokens,
    are never wanted and never sampled. Rows that repeat an id share their draw. An empty
    table gives an empty result.
    """
    wide = docs.select("doc_id", "source", "lang", "text", *([topic_col] if topic_col and topic_col not in ("source", "lang") else []))
    rows = written(with_features(wide, "text", topic_col, _model(docs, topic_col)).select("row.doc_id", "row.source", "row.lang", "topic", "tokens"), "features")
    cells = rates(_cells(rows), targets, short)
    return _joined(rows, cells).select(
        "doc_id",
        "source",
        "lang",
        "topic",
        F.col("tokens").alias("n_tokens"),
        F.col("share").alias("cell_share"),
        "keep_rate",
        ((F.col("tokens") > 0) & (_chance(F.col("doc_id"), seed) < F.col("keep_rate"))).alias("sampled"),
        "margin_gap",
    )


def sample_mixture(docs: DataFrame, targets: dict[str, DataFrame] | None = None, seed: int = 17, topic_col: str | None = None, short: float = SHORT) -> DataFrame:
    """The rows of docs that mixture() samples with this short, columns as they were."""
    rows = with_features(docs, "text", topic_col, _model(docs, topic_col))
    keyed = rows.select("row", F.col("row.doc_id").alias("__af_id"), F.col("row.source").alias("source"), F.col("row.lang").alias("lang"), "topic", "tokens")
    cells = rates(_cells(keyed.drop("row", "__af_id")), targets, short)
    kept = _joined(keyed, cells).where((F.col("tokens") > 0) & (_chance(F.col("__af_id"), seed) < F.col("keep_rate")))
    return kept.select("row.*")
