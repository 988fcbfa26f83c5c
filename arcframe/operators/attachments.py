"""Line-aligned attachments: side files whose lines follow the lines of a data file."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcframe.functions import digest
from arcframe.operators import cdx, derive
from arcframe.operators.joins import following
from arcframe.operators.layout import ids_within, in_ranges
from arcframe.session import stored
from arcframe.sources import text_ranges
from arcframe.sources.ranges import list_files, open_system

#: The number of a record that never comes.
NEVER = 1 << 60
AVAILABLE, MISMATCH, UNAVAILABLE, MALFORMED, NOT_PARSABLE = "Available", "ChecksumMismatch", "Unavailable", "Malformed", "NotParsable"


def attachment_path(path: str, name: str, extension: str = ".att") -> str:
    """The side file of a data file."""
    return f"{path.removesuffix('.gz')}.{name}{extension}.gz"


def exists(path: str) -> bool:
    try:
        return bool(list_files(path))
    except FileNotFoundError:
        return False


def aligned(records: DataFrame, side: DataFrame, parse: Callable[[Column], Column] = lambda content: content) -> DataFrame:
    """(file, line_no, checksum, content, status): records joined with the side line of their number.

    The plain path: both sides carry (file, line_no) and a blank line holds a record's slot.
    content is what follows the side line's checksum, on a mismatch too, and the whole line
    where it is malformed. parse gives null for content that cannot be parsed.
    """
    r = records.select("file", "line_no", F.col("checksum").alias("own"))
    s = side.select("file", "line_no", "line")
    joined = r.join(s, ["file", "line_no"], "left")
    head, rest = F.split("line", " ", 2)[0], F.get(F.split("line", " ", 2), F.lit(1))
    status = (
        F.when(F.col("line").isNull() | (F.trim("line") == ""), UNAVAILABLE)
        .when(rest.isNull(), MALFORMED)
        .when(parse(rest).isNull(), NOT_PARSABLE)
        .when(head != F.col("own"), MISMATCH)
        .otherwise(AVAILABLE)
    )
    content = F.when(status == MALFORMED, F.col("line")).when(status != UNAVAILABLE, rest)
    return joined.select("file", "line_no", F.col("own").alias("checksum"), content.alias("content"), status.alias("status"))


def _used_up(lines: DataFrame, records: DataFrame) -> DataFrame:
    """lines (file, pos, head) with `at`, the number of the record that uses each one up (NEVER: none).

    Line p is used up behind line p - 1, by the next record that has its checksum (any record,
    where head is null). Times are raised to the least ones that fulfil this: in each round all
    lines look for their record behind what the lines before them need at least, a running
    greatest value over ranges. Rounds end when nothing moves; unique checksums need three.
    """
    w = Window.partitionBy("__part", "file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = in_ranges(lines.select("file", "pos", "head", F.col("pos").alias("at")), ["file", "pos"]).drop("__pos")
    while True:
        ahead = F.col("at") - F.col("pos")
        parts = held.groupBy("__part", "file").agg(F.max(ahead).alias("__most"))
        carried = parts.select("__part", "file", F.max("__most").over(over).alias("__carried"))
        needs = held.withColumn("__within", F.max(ahead).over(w)).join(carried, ["__part", "file"])
        least = F.least(F.lit(NEVER), F.col("pos") + F.greatest(F.lit(0), F.coalesce("__within", F.lit(0)), F.coalesce("__carried", F.lit(0))))
        needs = needs.select("__part", "file", "pos", "head", F.col("at").alias("was"), least.alias("at"))
        found = following(records.select("file", F.col("checksum").alias("head"), "at", F.col("at").alias("met")), needs.where("head is not null"), ["file", "head"], "at", ["met"])
        found = found.withColumn("at", F.coalesce("met", F.lit(NEVER))).drop("met")
        raised = stored(found.unionByName(needs.where("head is null")), "walk")
        held = raised.drop("was")
        if raised.where("at <> was").isEmpty():
            return held.drop("__part")


def zipped(records: DataFrame, side: DataFrame, advance_on_mismatch: bool = False, parse: Callable[[str], object] | None = None) -> DataFrame:
    """aligned() for side files that skip records: a line is used up only when it matches.

    Comments (#) are skipped; blank and malformed lines, and content that parse raises on, are
    used up by any record. The walk through a file's lines is told by joins and running values
    over ranges (see _used_up), so a file is no single task's work.
    """

    @F.pandas_udf("boolean")
    def parsable(content: pd.Series) -> pd.Series:
        def good(x) -> bool:
            try:
                parse(x)
                return True
            except Exception:
                return False

        return content.map(lambda x: x is not None and good(x))

    own = ids_within(records.select("file", "line_no", "checksum"), "file", ["line_no"], "at")
    text = side.where(~F.trim("line").startswith("#")).select("file", F.col("line_no").alias("side_no"), "line")
    head, rest = F.substring_index("line", " ", 1), F.when(F.instr("line", " ") > 0, F.expr("substring(line, instr(line, ' ') + 1)"))
    good = parsable(rest) if parse is not None else F.lit(True)
    kind = F.when(F.trim("line") == "", UNAVAILABLE).when(rest.isNull(), MALFORMED).when(~good, NOT_PARSABLE).otherwise(AVAILABLE)
    content = F.when(F.col("kind") == MALFORMED, F.col("line")).when(F.col("kind") != UNAVAILABLE, rest)
    lines = stored(ids_within(text, "file", ["side_no"], "pos").withColumn("kind", kind).select("file", "pos", "kind", content.alias("content"), F.when(F.col("kind") == AVAILABLE, head).alias("head")), "side")
    if advance_on_mismatch:
        used = lines.withColumn("at", F.col("pos"))
    else:
        used = lines.drop("head").join(_used_up(lines, own), ["file", "pos"])
    # Of the lines that no record uses up, the first one is what all later records meet.
    waiting = used.where(F.col("at") >= NEVER).groupBy("file").agg(F.min("pos").alias("pos"))
    met = used.where(F.col("at") < NEVER).unionByName(used.where(F.col("at") >= NEVER).join(waiting, ["file", "pos"], "left_semi"))
    found = following(met.withColumn("used_at", F.col("at")), own, ["file"], "at", ["used_at", "kind", "content", "head"])
    here = F.col("used_at") == F.col("at")
    matches = here & (F.col("kind") != AVAILABLE) | (F.col("head") == F.col("checksum"))
    status = F.when(F.col("kind").isNull(), UNAVAILABLE).when(matches, F.col("kind")).otherwise(MISMATCH)
    return found.select("file", "line_no", "checksum", F.when(F.col("kind").isNotNull(), F.col("content")).alias("content"), status.alias("status"))


def load(records: DataFrame, paths: dict[str, str], names: list[str], extension: str = ".att", advance_on_mismatch: bool = False) -> DataFrame:
    """records (file, line_no, checksum, ...) with a struct (content, status) by each name of attachment.

    paths: data file -> its side file without name and extension; side files that do not exist
    give Unavailable.
    """
    out = records
    for name in names:
        places = {f: attachment_path(p, name, extension) for f, p in paths.items()}
        found = text_ranges.load(records.sparkSession, there) if (there := [p for p in places.values() if exists(p)]) else None
        if found is None:
            side = records.sparkSession.createDataFrame([], "file string, line_no long, line string")
        else:
            back = records.sparkSession.createDataFrame([(p, f) for f, p in places.items()], "path string, file string")
            order = F.struct("range", "offset", "within")
            numbered = ids_within(found.select(F.col("file").alias("path"), order.alias("order"), "line"), "path", ["order"], "line_no")
            side = numbered.join(back, "path").select("file", "line_no", "line")
        zipped_rows = zipped(records, side, advance_on_mismatch).select("file", "line_no", F.struct("content", "status").alias(name))
        out = out.join(zipped_rows, ["file", "line_no"])
    return out


def _records(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(file, line_no, line) of the data files of a path, side files left out, and their names."""
    files = [f for f, _ in list_files(path) if not re.search(r"\.(att|cdxa)(\.gz)?$", f)]
    found = text_ranges.load(spark, files)
    numbered = ids_within(found.select("file", F.struct("range", "offset", "within").alias("order"), "line"), "file", ["order"], "line_no")
    return numbered.drop("order"), {f: f for f in files}


def load_text(spark: SparkSession, path: str, names: list[str], extension: str = ".att") -> DataFrame:
    """(file, line_no, checksum, line) of text files with their attachments; a line's checksum is its 32-bit string hash."""
    rows, paths = _records(spark, path)
    return load(rows.withColumn("checksum", digest.string_hash(F.col("line")).cast("string")), paths, names, extension)


def load_cdx(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CDX columns with file, line_no and the attachments, which follow the captures' digests; other lines are no records."""
    rows, paths = _records(spark, path)
    captures = cdx.parse(rows, "line", "file", "line_no")
    return load(captures.withColumn("checksum", F.col("digest")), paths, names, ".cdxa").drop("checksum")


def side_lines(records: DataFrame) -> DataFrame:
    """(file, line_no, line) of records with (checksum, content): a blank line without content."""
    line = F.when(F.col("content").isNull(), "").otherwise(F.concat_ws(" ", "checksum", F.regexp_replace("content", r"[\r\n]+", " ")))
    return records.select("file", "line_no", line.alias("line"))


def save_side(rows: DataFrame, name: str, extension: str = ".att") -> int:
    """Writes the side files of rows (file, line_no, line), one by each data file, and gives their number.

    Lines are sorted and streamed; a file appears under its name once it is whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = system = target = machine = None
        done = 0

        def close() -> None:
            nonlocal done
            out.write(machine.flush())
            out.close()
            system.move(f"{target}.{mark}", target)
            done += 1

        mark = uuid.uuid4().hex
        for batch in batches:
            for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != path:
                    if out is not None:
                        close()
                    path, machine = file, zlib.compressobj(6, zlib.DEFLATED, 31)
                    system, target = open_system(attachment_path(file, name, extension))
                    out = system.open_output_stream(f"{target}.{mark}", compression=None)
                out.write(machine.compress(f"{line}\n".encode()))
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["files"])

    # By a hash of the name: where rows stand by file already, Spark leaves out a shuffle by it, and may then part a file's rows again.
    dealt = rows.repartition(F.xxhash64("file")).sortWithinPartitions("file", "line_no").select("file", "line")
    return dealt.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def pipe_attach(records: DataFrame, value: Column, command: str, name: str, extension: str = ".att", timeout: int = 600) -> int:
    """Side files of records (file, line_no, checksum, ...) whose content is what a shell command gives for each value; their number.

    value is an expression over records, one line a record; where it is null nothing is piped
    and the record has a blank side line. A failed command fails the task (derive.pipe).
    """
    given = records.select("file", "line_no", "checksum", value.cast("string").alias("given"))
    piped = derive.pipe(given.where("given is not null"), "given", command, "content", timeout).drop("given")
    blank = given.where("given is null").select("file", "line_no", "checksum", F.lit(None).cast("string").alias("content"))
    return save_side(side_lines(piped.unionByName(blank)), name, extension)
