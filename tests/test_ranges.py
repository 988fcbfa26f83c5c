"""Text ranges, groups over borders, budgets and the attachment walk, against plain Python."""

from __future__ import annotations

import gzip
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcframe.operators import attachments, budgets, joins, layout, runs
from arcframe.sources import budgeted, ranges, text_ranges


def written(folder, bodies, packed=None):
    for i, body in enumerate(bodies):
        if packed is None:
            (folder / f"f{i}.txt").write_bytes(body)
        else:  # members of `packed` bytes
            (folder / f"f{i}.txt.gz").write_bytes(b"".join(gzip.compress(body[a : a + packed]) for a in range(0, max(1, len(body)), packed)))


def texts(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        own = [bytes(rng.choice(b"ab\r ") for _ in range(rng.choice((0, 0, 1, 3, 9, 60)))) for _ in range(25)]
        out.append(b"\n".join(own) + rng.choice((b"", b"\n")))
    return [*out, b"", b"\n\n", b"x" * 200, b"y" * 200 + b"\n"]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 10_000])
@pytest.mark.parametrize("packed", [None, 1, 5, 64, 10_000])
def test_each_line_belongs_to_one_range(tmp_path, split, packed):
    bodies = texts()
    written(tmp_path, bodies, packed)
    for (path, size), body in zip(ranges.list_files(str(tmp_path)), bodies):
        want = body.split(b"\n")[: -1 if body.endswith(b"\n") or not body else None]
        found = []
        for begin in range(0, size, split):
            f = ranges.Ranged(path)
            found += list(text_ranges.lines(f, begin, begin + split))
            f.close()
        assert [line for *_, line in found] == want
        assert len({x[:2] for x in found}) == len(found)
        if packed is None:
            assert [body[at : at + len(line)] for at, _, line in found] == want


def test_source_gives_files_and_places(spark, tmp_path):
    bodies = [x for x in texts(2) if x]
    written(tmp_path, bodies)
    rows = text_ranges.load(spark, str(tmp_path), 40).collect()
    assert len({(r["file"], r["offset"]) for r in rows}) == len(rows)
    for r in rows:
        body = bodies[int(r["file"].rsplit("/f", 1)[1].removesuffix(".txt"))]
        assert body[r["offset"] :].split(b"\n")[0].removesuffix(b"\r").decode() == r["line"]
    assert len(rows) == sum(len(b.split(b"\n")) - b.endswith(b"\n") for b in bodies)


def test_gzip_factor_and_a_file_of_one_member(spark, tmp_path):
    body = b"".join(b"line %06d\n" % i for i in range(40_000))
    (tmp_path / "a.gz").write_bytes(gzip.compress(body))
    factor = text_ranges.gzip_factor(str(tmp_path / "a.gz"), 100_000)
    assert 0.5 < factor / (len(body) / (tmp_path / "a.gz").stat().st_size) < 2
    assert text_ranges.load(spark, str(tmp_path), 50_000).count() == 40_000
    (tmp_path / "b.txt").write_bytes(b"plain")
    assert text_ranges.gzip_factor(str(tmp_path / "b.txt")) == 1.0


@pytest.mark.parametrize("split", [3, 25, 10_000])
def test_groups_reach_over_ranges_and_files(spark, tmp_path, split):
    rng = random.Random(5)
    keys = list(itertools.chain.from_iterable([rng.choice("abc-")] * rng.choice((1, 1, 2, 40)) for _ in range(60)))
    cuts = sorted(rng.sample(range(len(keys)), 9))
    parts = [keys[a:b] for a, b in zip([0, *cuts], [*cuts, len(keys)])]
    written(tmp_path, ["".join(f"{k}{i}\n" for i, k in enumerate(p)).encode() for p in parts])
    rows = text_ranges.load(spark, str(tmp_path), split)
    key = F.nullif(F.substring("line", 1, 1), F.lit("-"))
    want = [(k, len(list(g))) for k, g in itertools.groupby(keys) if k != "-"]
    found = sorted(runs.whole_groups(rows, key).collect(), key=lambda r: r["first"])
    assert [(r["key"], r["rows"]) for r in found] == want
    labelled = runs.label_groups(rows, key).groupBy("group").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n")).orderBy("group").collect()
    assert [(r["key"], r["n"]) for r in labelled] == want
    plan = runs.label_groups(rows, key)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_groups_of_nothing(spark, tmp_path):
    (tmp_path / "e.txt").write_bytes(b"")
    rows = text_ranges.load(spark, str(tmp_path))
    assert rows.count() == 0 and runs.whole_groups(rows, F.col("line")).count() == 0


def test_folds_compose_to_the_sequence():
    rng = random.Random(1)
    for _ in range(300):
        budget, n = rng.randint(1, 30), rng.randint(0, 25)
        costs = [rng.choice([0, 0, 1, 2, 3, 5, 8, budget, budget + 3]) for _ in range(n)]
        cuts = sorted(rng.choices(range(n + 1), k=rng.randint(0, 4)))
        folds = [budgets.Fold.of(np.array(costs[a:b], np.int64), budget) for a, b in zip([0, *cuts], [*cuts, n])]
        whole = folds[0]
        for fold in folds[1:]:
            whole = whole.then(fold)
        for held in range(budget + 5):
            bins, after = 0, held
            for cost in costs:
                if after and after + cost > budget:
                    bins, after = bins + 1, 0
                after += cost
            assert whole.at(held) == (bins, after)


def test_budgets_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(budgets, "FAN", 3)
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 1, 5, 7, 40, None]), "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cost long, lane string")
    got = {r["ord"]: r["bin"] for r in layout.budget_bins(df, "id", "cost", 20, parts=17).collect()}
    assert [got[i] for i in range(400)] == list(budgets.next_fit([c or 0 for _, c, _ in rows], 20))
    laned = {r["ord"]: r["bin"] for r in layout.budget_bins(df, "id", "cost", 20, "lane", parts=11).collect()}
    for lane in ("hot", "a", "b", None):
        own = [(i, c or 0) for i, c, x in rows if x == lane]
        assert [laned[i] for i, _ in own] == list(budgets.next_fit([c for _, c in own], 20))
    assert layout.budget_bins(df.limit(0), "id", "cost", 20).count() == 0


def test_partitions_stay_within_a_budget(spark, tmp_path):
    rng = random.Random(3)
    bodies = ["".join("z" * rng.randint(0, 30) + "\n" for _ in range(n)).encode() for n in (90, 1, 0, 200, 3)] + [b"q" * 500 + b"\n"]
    written(tmp_path, bodies)
    (tmp_path / "g.txt.gz").write_bytes(gzip.compress(b"w" * 300 + b"\nv\n"))
    cost = F.char_length("line")
    loaded = budgeted.load(spark, str(tmp_path), 100, cost, 64)
    assert sorted(r["line"] for r in loaded.collect()) == sorted(x.decode() for b in [*bodies, b"w" * 300 + b"\nv\n"] for x in b.split(b"\n")[:-1])
    costs = [len(x) for b in bodies for x in b.split(b"\n")[:-1]]
    found = [(r["partition"], r["rows"], r["cost"]) for r in budgeted.partition_costs(loaded, cost).orderBy("partition").collect()]
    want = {}
    for number, c in zip(budgets.next_fit([*costs, 301], 100), [*costs, 301]):
        n, total = want.get(number, (0, 0))
        want[number] = (n + 1 + (c == 301), total + c)
    assert [(n, c) for _, n, c in found] == [want[k] for k in sorted(want)]
    again = budgeted.reload(spark.range(50).select(F.col("id").cast("string").alias("s")), "s", 7, F.char_length("line"))
    assert again.count() == 50 and budgeted.partition_costs(again, cost).agg(F.max("cost")).first()[0] <= 7
    files = {r["file"].rsplit("/", 1)[1]: (r["lines"], r["cost"]) for r in budgeted.file_costs(spark, str(tmp_path), F.when(cost < 20, cost), 32).collect()}
    assert files["f5.txt"] == (1, 0) and files["f1.txt"][0] == 1


def walk(checksums, lines, parse, advance=False):
    queue, at, out = [x for x in lines if not x.strip().startswith("#")], 0, []
    for own in checksums:
        status, content = "Unavailable", None
        if at < len(queue):
            head, sep, rest = queue[at].partition(" ")
            if not queue[at].strip():
                at += 1
            elif not sep:
                status, content, at = "Malformed", head, at + 1
            elif rest == "bad" and parse:
                status, content, at = "NotParsable", rest, at + 1
            elif head == own:
                status, content, at = "Available", rest, at + 1
            else:
                status, content, at = "ChecksumMismatch", rest, at + advance
        out.append((own, content, status))
    return out


@pytest.mark.parametrize("advance", [False, True])
def test_walk_over_ranges(spark, advance):
    rng = random.Random(6)
    records, side, want = [], [], []
    for name in "abcdef":
        checksums = [rng.choice("uvwxyz") if name < "d" else f"{name}{i}" for i in range(rng.choice((0, 1, 30, 60)))]
        kept = [c for c in checksums if rng.random() < 0.6]
        lines = [rng.choice((f"{c} {i} t",) * 8 + ("", "# note", "odd", f"{c} bad", "no such")) if name != "f" else f"{c} {i}" for i, c in enumerate(kept)]
        records += [(name, 10 * i, c) for i, c in enumerate(checksums)]
        side += [(name, 7 * i, x) for i, x in enumerate(lines)]
        want += [(name, 10 * i, *x) for i, x in enumerate(walk(checksums, lines, True, advance))]

    def parse(x):
        if x == "bad":
            raise ValueError

    one = spark.createDataFrame(records, "file string, line_no long, checksum string")
    two = spark.createDataFrame(side, "file string, line_no long, line string")
    got = attachments.zipped(one, two, advance, parse).select("file", "line_no", "checksum", "content", "status").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert attachments.zipped(one, two.limit(0)).where("status <> 'Unavailable' or content is not null").count() == 0


def test_attachments_by_path(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"hello\n\nw\xc3\xb6rld\n")
    (tmp_path / "two.txt.gz").write_bytes(gzip.compress(b"lone\n"))
    assert spark.range(1).select(__import__("arcframe.functions.digest", fromlist=["x"]).string_hash(F.lit("hello"))).first()[0] == 99162322
    bare = attachments.load_text(spark, str(tmp_path), ["note"])
    assert {r["note"]["status"] for r in bare.collect()} == {"Unavailable"} and bare.count() == 4
    side = bare.select("file", "line_no", F.concat_ws(" ", "checksum", F.concat(F.lit("about "), "line")).alias("line")).where("line_no <> 1")
    assert attachments.save_side(side, "note") == 2
    found = {(r["line"]): (r["note"]["content"], r["note"]["status"]) for r in attachments.load_text(spark, str(tmp_path), ["note", "none"]).collect()}
    assert found == {"hello": ("about hello", "Available"), "": ("about wörld", "ChecksumMismatch"), "wörld": ("about wörld", "Available"), "lone": ("about lone", "Available")}


def test_following_rows(spark):
    rng = random.Random(2)
    have = [(rng.choice("abc"), rng.randrange(50)) for _ in range(40)]
    ask = [(i, rng.choice("abcd"), rng.randrange(60)) for i in range(80)]
    df = spark.createDataFrame([(k, t, t) for k, t in have], "k string, t long, got long")
    asked = spark.createDataFrame(ask, "n long, k string, t long")
    found = {r["n"]: r["got"] for r in joins.following(df, asked, ["k"], "t", ["got"]).collect()}
    assert found == {n: min((x for j, x in have if j == k and x >= t), default=None) for n, k, t in ask}


@pytest.fixture(scope="module")
def sorted_lines(spark):
    from arcframe.sources import indexed

    rng = random.Random(12)
    keys = [f"{'hot' if rng.random() < 0.4 else rng.choice('abcxyzé')},{rng.randrange(40):02d})/{rng.randrange(9)}" for _ in range(900)]
    rows = [(k, f"line {i}") for i, k in enumerate(keys)]
    path = indexed.new_folder(spark, "test")
    indexed.write_indexed(spark.createDataFrame(rows, "key string, line string"), path, 11)
    return path, rows


def test_partitions_of_whole_groups(spark, sorted_lines):
    from arcframe.sources import index_ranges

    path, rows = sorted_lines
    group = lambda key: F.substring_index(key, ")", 1)
    found = [tuple(r) for r in index_ranges.range_partitions(spark, path, 7, group).collect()]
    assert sorted(x[1:] for x in found) == sorted(rows)
    owner = {}
    for number, key, _ in found:
        assert owner.setdefault(key.split(")")[0], number) == number
    order = sorted(owner, key=str.encode)
    assert [owner[g] for g in order] == sorted(owner.values()) and len(set(owner.values())) > 3
    assert sorted(tuple(r) for r in index_ranges.range_partitions(spark, path, 1, group).select("key", "line").collect()) == sorted(rows)


def test_samples_are_exact_and_repeat(spark, sorted_lines):
    from arcframe.sources import index_ranges

    path, rows = sorted_lines
    one, two, other = (index_ranges.sample(spark, path, 60, seed).collect() for seed in (1, 1, 2))
    assert len({r["place"] for r in one}) == 60 and {(r["key"], r["line"]) for r in one} <= set(rows)
    assert sorted(one) == sorted(two) != sorted(other)
    assert index_ranges.sample(spark, path, 5000).count() == 900 and index_ranges.sample(spark, path, 0).count() == 0


def test_files_meet_without_a_shuffle_of_lines(spark, sorted_lines):
    from arcframe.sources import index_ranges, indexed

    path, rows = sorted_lines
    rng = random.Random(13)
    others = [(k if rng.random() < 0.8 else f"only,{k}", f"other {i}") for i, (k, _) in enumerate(rng.sample(rows, 200))]
    right = indexed.new_folder(spark, "test")
    indexed.write_indexed(spark.createDataFrame(others, "key string, line string"), right, 5)
    found = index_ranges.cogroup(spark, path, right, 6)
    got = {r["key"]: (sorted(r["left"]), sorted(r["right"])) for r in found.collect()}
    want = {k: (sorted(x for j, x in rows if j == k), sorted(x for j, x in others if j == k)) for k in {k for k, _ in rows + others}}
    assert got == want and found.count() == len(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]


def test_index_candidates_match_every_pair(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    index = sorted({(rng.randrange(3), word()) for _ in range(40)})
    prefixes = sorted({word() for _ in range(15)} | {"zz", "é"})
    want = set()
    for i, (part, key) in enumerate(index):
        after = index[i + 1][1] if i + 1 < len(index) and index[i + 1][0] == part else None
        want |= {(part, key, p) for p in prefixes if key <= p + "\U0010ffff" and (after is None or after >= p)}
    df = spark.createDataFrame(index, "part long, key string")
    found = joins.index_candidates(df, "key", "part", spark.createDataFrame([(p,) for p in prefixes], "prefix string"), "prefix")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_extraction_by_budget(spark, tmp_path):
    from arcframe.sources import warc

    record = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {3 + 100 * (i % 3)}\r\n\r\n".encode() + b"%03d" % i + b"x" * (100 * (i % 3)) + b"\r\n\r\n"
    for name, lo in (("a", 0), ("b", 30)):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(lo, lo + 30)))
    warc.register(spark)
    pointers = spark.read.format("warc").load(str(tmp_path)).select("file", "offset", "length", F.substring("payload", 1, 3).cast("string").alias("number"))
    found = warc.extract_by_budget(pointers, 500).select("bin", "length", "row.number", "payload", F.spark_partition_id().alias("task")).collect()
    assert sorted(bytes(r["payload"])[:3].decode() for r in found) == [f"{i:03d}" for i in range(60)]
    assert all(bytes(r["payload"])[:3].decode() == r["number"] for r in found)
    sizes = {}
    for r in found:
        sizes.setdefault(r["task"], []).append(r["length"])
    assert all(sum(x) <= 500 or len(x) == 1 for x in sizes.values()) and len(sizes) > 5


def test_a_side_file_has_all_lines_whatever_dealt_its_rows(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"")
    file = f"file://{tmp_path}/one.txt"
    rows = spark.range(0, 2000, 1, 4).select(F.concat(F.lit(file), F.substring(F.col("id").cast("string"), 1, 0)).alias("file"), F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
    rows = rows.join(rows.groupBy("file").agg(F.min("line_no").alias("first")), "file")
    # A join by file that Spark plans as a shuffle, and turns into a broadcast of its small side once it runs.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert attachments.save_side(rows, "note") == 1
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert gzip.decompress((tmp_path / "one.txt.note.att.gz").read_bytes()).decode().split("\n")[:-1] == [f"line {i}" for i in range(2000)]


def test_equal_index_lines_are_candidates_each(spark):
    index = spark.createDataFrame([(0, "a"), (0, "ba"), (0, "ba"), (0, "c"), (1, "a"), (1, "a")], "part long, key string")
    found = joins.index_candidates(index, "key", "part", spark.createDataFrame([("b",)], "prefix string"), "prefix")
    assert sorted(map(tuple, found.collect())) == [(0, "a", "b"), (0, "ba", "b"), (0, "ba", "b"), (1, "a", "b")]


@pytest.mark.parametrize("packed", [None, 1, 5, 64])
def test_many_small_ranges_share_a_task_and_keep_their_numbers(tmp_path, monkeypatch, packed):
    bodies = texts(7)
    written(tmp_path, bodies, packed)
    want, number = [], 0
    for path, size in ranges.list_files(str(tmp_path)):
        for begin in range(0, size, 7):
            f = ranges.Ranged(path)
            want += [(path, offset, within, line.removesuffix(b"\r").decode(), number) for offset, within, line in text_ranges.lines(f, begin, begin + 7)]
            f.close()
            number += 1
    read = text_ranges.TextRanges({"path": str(tmp_path), "splitBytes": "7", "tasks": "9"}).reader(None)
    monkeypatch.setattr(text_ranges, "gzip_factor", lambda path: 1.0)  # ranges of 7 packed bytes
    tasks = read.partitions()
    found = [tuple(x.values()) for task in tasks for batch in read.read(task) for x in batch.to_pylist()]
    assert found == want and len({x[4] for x in found}) > 8
    assert 9 <= len(tasks) <= 30 < number


def test_groups_over_tasks_of_many_ranges(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"".join(b"%d %d\n" % (i // 1000, i) for i in range(4000)))
    rows = text_ranges.load(spark, str(tmp_path), 20)
    assert rows.select("range").distinct().count() > 1300 and rows.rdd.getNumPartitions() <= 2 * 4 * spark.sparkContext.defaultParallelism
    found = runs.whole_groups(rows, F.split("line", " ")[0]).collect()
    assert sorted((r["key"], r["rows"], r["first"]["offset"]) for r in found) == [("0", 1000, 0), ("1", 1000, 5890), ("2", 1000, 12890), ("3", 1000, 19890)]


@pytest.mark.parametrize("part_bytes", [256, 4 << 20])
def test_small_bins_share_tasks_and_have_partitions(spark, tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(budgeted, "PART_BYTES", part_bytes)  # four ranges a part, or all of them
    rng = random.Random(8)
    bodies = ["".join("z" * rng.randint(0, 30) + f"{i}\n" for i in range(n)).encode() for n in (300, 0, 1, 200)]
    written(tmp_path, bodies)
    cost = F.char_length("line")
    every = [x.decode() for b in bodies for x in b.split(b"\n")[:-1]]
    want = list(zip(budgets.next_fit([len(x) for x in every], 50), every))
    found = budgeted.load(spark, str(tmp_path), 50, cost, 64).select("range", "line", F.spark_partition_id().alias("partition")).collect()
    assert [(r["range"], r["line"]) for r in found] == want and all(r["partition"] == r["range"] for r in found)
    plan = budgeted.write_plan(spark, str(tmp_path), 50, cost, 64)
    tasks = text_ranges.TextRanges({"plan": plan, "tasks": "4"}).reader(None).partitions()
    assert 4 <= len(tasks) <= 9 and want[-1][0] > 100
