"""Charsets, savers that route rows to files, groups of files, jobs over splits."""

from __future__ import annotations

import gzip
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from arcframe.functions import charsets
from arcframe.operators import attachments
from arcframe.sources import file_groups, http, lines, routed, text_ranges


def files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if not n.startswith((".", "_"))}


@pytest.mark.parametrize(
    "body, charset, want",
    [
        ("é ü".encode(), ("utf-8",), "é ü"),
        ('<meta charset="iso-8859-1">\né'.encode("latin-1"), ("utf-8",), '<meta charset="iso-8859-1">\né'),
        ("<?xml version='1.0' encoding='windows-1252'?>\n€".encode("cp1252"), ("utf-8",), "<?xml version='1.0' encoding='windows-1252'?>\n€"),
        # What stands before the declaration is read by what was known then.
        (b"a\xe9b\ncharset=iso-8859-1\n\xe9", ("utf-8",), "ab\ncharset=iso-8859-1\né"),
        # Lines in two charsets; the declared one is tried first.
        (b"charset=utf-8\n\xc3\xa9\n\xe9", ("iso-8859-1",), "charset=utf-8\né\né"),
        (b"charset=no-such\n\xc3\xa9", ("utf-8",), "charset=no-such\né"),
        (b"", ("utf-8",), ""),
        (b"\n\n", ("utf-8",), "\n"),
        (b"\xff", ("no-such",), ""),
        (None, ("utf-8",), None),
    ],
)
def test_adaptive_text(body, charset, want):
    assert charsets.adaptive_text(body, charset) == want


def test_body_string_of_markup_declares_its_charset():
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html%s\r\n\r\n"
    page = '<meta charset="windows-1252">\n<p>10 €</p>\n'.encode("cp1252")
    assert http.message(head % b"" + page)[7] == page.decode("cp1252")
    assert http.message(head % b"; charset=windows-1252" + page)[7] == page.decode("cp1252")
    assert http.message(head % b"; charset=utf-8" + page)[7] == page.decode("cp1252")
    assert http.message(head.replace(b"html", b"plain") % b"" + page)[7] == page.decode("latin-1")


def test_codecs_by_name_and_first_bytes(spark, tmp_path):
    press = zstandard.ZstdCompressor()
    given = {"a.gz": gzip.compress(b"one") + gzip.compress(b"two"), "b": gzip.compress(b"three"), "c.zst": press.compress(b"four") + press.compress(b"five"), "d": b"plain", "e": b""}
    for name, body in given.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in lines.read_binary(spark, str(tmp_path), unpack=True).collect()}
    assert got == {"a.gz": b"onetwo", "b": b"three", "c.zst": b"fourfive", "d": b"plain"}


def test_parts_resume_and_never_overwrite(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit("n"), "id").alias("line"))
    assert routed.save_parts(df, "line", path) == 100
    with pytest.raises(FileExistsError):
        routed.save_parts(df, "line", path)
    assert routed.save_parts(df, "line", path, skip_if_exists=True) == 0
    whole = files(path)
    # A run that was broken off: no flag, one part missing, one that was never finished.
    os.remove(f"{path}/_complete")
    os.remove(f"{path}/part-00002.txt")
    (tmp_path / "parts" / "_held-part-00002.txt").write_text("half")
    (tmp_path / "parts" / "part-00001.txt").write_text("kept\n")
    with pytest.raises(FileExistsError):
        routed.save_parts(df, "line", path, skip_if_exists=True)
    assert routed.save_parts(df, "line", path, skip_if_exists=True, per_file=True) == 25
    assert files(path) == {**whole, "part-00001.txt": b"kept\n"}
    assert routed.save_parts(df.where("false"), "line", str(tmp_path / "none")) == 0
    assert files(tmp_path / "none") == {} and os.path.exists(tmp_path / "none" / "_complete")


def test_named_files_of_binary_values(spark, tmp_path):
    rows = [("a/x", 2, b"\x00\xff"), ("a/x", 1, b"\n"), ("a/x", 1, b"\n"), ("b", 1, None), ("b", 2, b""), ("ü e", 1, b"z")]
    df = spark.createDataFrame(rows, "name string, file int, data binary")
    assert routed.save_named_files(df, "name", "data", str(tmp_path / "n"), ["file"]) == 6
    assert files(tmp_path / "n") == {"a/x": b"\n\n\x00\xff", "b": b"", "ü e": b"z"}
    with pytest.raises(Exception, match="must not leave"):
        routed.save_named_files(spark.createDataFrame([("../y", b"x")], "name string, data binary"), "name", "data", str(tmp_path / "o"), [])
    with pytest.raises(Exception, match="no file name"):
        routed.save_named_files(spark.createDataFrame([(None, b"x")], "name string, data binary"), "name", "data", str(tmp_path / "m"), [])


def test_a_hot_name_is_cut_into_files(spark, tmp_path):
    df = spark.range(0, 300, 1, 5).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("name"), "id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("data"))
    assert routed.save_named_files(df, "name", "data", str(tmp_path / "s"), ["id"], 50) == 300
    found = files(tmp_path / "s")
    assert all(len(body) <= 50 for body in found.values())
    names = {n.rpartition("-")[0] for n in found}
    assert names == {"hot", *(f"c{i}" for i in range(5))}
    for name in names:
        own = [r["data"] for r in df.where(F.col("name") == name).orderBy("id").collect()]
        assert "".join(found[n].decode() for n in sorted(found) if n.rpartition("-")[0] == name) == "".join(own)


def next_fit(costs, most):
    out, held = [], 0
    for i, c in enumerate(costs):
        if not out or held > 0 and held + c > most:
            out.append([])
            held = 0
        out[-1].append(i)
        held += c
    return out


@pytest.mark.parametrize("by, most", [("bytes", 40), ("bytes", 1), ("lines", 7), ("lines", 1000)])
def test_splits_by_bytes_and_lines(spark, tmp_path, by, most):
    text = ["é" * (i % 9) for i in range(100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(text)], "id int, line string").repartition(3)
    assert routed.save_splits(df, "line", str(tmp_path / "s"), ["id"], most, by) == 100
    bins = next_fit([len(x.encode()) + 1 if by == "bytes" else 1 for x in text], most)
    assert files(tmp_path / "s") == {f"split-{n:05d}.txt": "".join(text[i] + "\n" for i in own).encode() for n, own in enumerate(bins)}


def test_splits_never_part_a_group(spark, tmp_path):
    rows = [(i, "abcde"[i % 4 if i < 60 else 4], f"l{i}") for i in range(100)] + [(200, None, "none")]
    df = spark.createDataFrame(rows, "id int, g string, line string")
    assert routed.save_splits(df, "line", str(tmp_path / "s"), ["id"], 32, "lines", "g") == 101
    got = [body.decode().splitlines() for _, body in sorted(files(tmp_path / "s").items())]
    want = {g: [x for _, k, x in rows if k == g] for g in (None, *"abcde")}
    groups = [None, *"abcde"]
    assert got == [sum((want[groups[i]] for i in own), []) for own in next_fit([len(want[g]) for g in groups], 32)]


def test_groups_of_files_keep_their_order(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"f{i}.txt").write_text("".join(f"{i}-{j}\n" for j in range(3)) if i != 3 else "")
    rows = file_groups.load_groups(spark, str(tmp_path), files=2).withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    by = {}
    for r in rows:
        by.setdefault((r["group"], r["p"]), []).append(r["line"])
    assert len(by) == 4 and sorted(g for g, _ in by) == ["0", "1", "2", "3"]
    for (g, _), found in by.items():
        assert found == [f"{i}-{j}" for i in (2 * int(g), 2 * int(g) + 1) if i < 7 and i != 3 for j in range(3)]
    own = file_groups.load_groups(spark, str(tmp_path), F.when(F.col("size") > 0, "full"))
    assert {(r["group"], r["line"]) for r in own.collect()} == {("full", f"{i}-{j}") for i in range(7) if i != 3 for j in range(3)}


def test_partitions_that_a_user_names(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}").write_text("x" * i)
    found = file_groups.load_partitions(spark, str(tmp_path), F.when(F.col("size") > 0, F.sequence(F.lit(1), F.col("size").cast("int"))), lambda file, p: iter([(file[-1], p * 10)] * 2), "name string, value int")
    assert sorted((r["partition"], r["name"], r["value"]) for r in found.collect()) == [(1, "1", 10)] * 2 + [(1, "2", 10)] * 2 + [(2, "2", 20)] * 2


@pytest.mark.parametrize("split", [1, 7, 50, 10_000])
@pytest.mark.parametrize("packed", [False, True])
def test_split_and_merge_equals_the_whole_run(spark, tmp_path, split, packed):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo" + "x" * 30)
    (tmp_path / "in" / "d" / "a.txt").write_text("three\n")
    (tmp_path / "in" / "empty").write_text("")
    done = file_groups.split_and_merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda found: (x.upper() for x in found if x), file_groups.even_splits(split), packed=packed)
    unpack = gzip.decompress if packed else bytes
    assert {n: unpack(b) for n, b in files(tmp_path / "out").items()} == {"a.txt": b"ONE\nTWO" + b"X" * 30 + b"\n", "d/a.txt": b"THREE\n", "empty": b""}
    assert sorted(r["rows"] for r in done.collect()) == [0, 1, 2]


def test_a_broken_off_split_job_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("one\ntwo\n")
    work = tmp_path / "work"
    (work / "a").mkdir(parents=True)
    (work / "a" / "00000000").write_text("kept\n")
    file_groups.split_and_merge(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda found: found, file_groups.even_splits(3), str(work))
    assert files(tmp_path / "out") == {"a": b"kept\ntwo\n"}


def test_piped_attachments_leave_blank_slots(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\nz\n")
    bare = attachments.load_text(spark, str(tmp_path), [])
    assert attachments.pipe_attach(bare, F.when(F.col("line") != "y", F.col("line")), "sed s/^/got-/", "p") == 1
    assert gzip.decompress((tmp_path / "a.p.att.gz").read_bytes() if (tmp_path / "a.p.att.gz").exists() else (tmp_path / "a.txt.p.att.gz").read_bytes()).decode().splitlines()[1] == ""
    got = sorted((r["line"], r["p"]["content"], r["p"]["status"]) for r in attachments.load_text(spark, str(tmp_path), ["p"]).collect())
    assert got == [("x", "got-x", "Available"), ("y", None, "Unavailable"), ("z", "got-z", "Available")]
    with pytest.raises(Exception, match="command gave code 3"):
        attachments.pipe_attach(bare, F.col("line"), "exit 3", "q")
