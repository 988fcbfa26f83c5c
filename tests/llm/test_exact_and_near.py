"""Exact duplicates, the Jaccard join, components and Rice coding against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcframe.llm import components, exact_dedup, golomb, ngram_join

SPACE = re.compile("[\x20\x09-\x0d]+")


@pytest.mark.parametrize("k", [0, 1, 5, 17])
def test_rice_round_trip(k):
    rng = random.Random(k)
    for size in (0, 1, 2, 50):
        values = np.array(sorted(rng.sample(range(1 << 12 if k < 5 else 1 << 30), size)), np.int64)
        assert golomb.decode(golomb.encode(values, k), size, k).tolist() == values.tolist()


def exact_reference(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, sha) for i, _ in members]
    return sorted(out, key=repr)


def as_rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_exact_duplicates(docs):
    want = exact_reference([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert as_rows(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_duplicates_meet_in_a_shuffle_beyond_the_broadcast_bound(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    want = exact_reference([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert as_rows(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_wrong_marks_only_add_suspects(docs):
    rows = docs.count()
    marks, _ = exact_dedup._marks(docs, "doc_id", "text")
    shifted = exact_dedup._suspects(docs.repartition(2), "doc_id", "text", marks, rows, [])
    groups = exact_dedup._groups(shifted.where("__af_suspect").select("__af_sha", "__af_norm", "__af_text", "__af_id"))
    want = {k[4] for k in exact_reference([(r["doc_id"], r["text"]) for r in docs.collect()]) if k[2] > 1}
    assert want <= {r["__af_sha"] for r in groups.where("__af_size > 1").collect()}


def test_repeated_rows_leave_one(spark, nothing):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "ab", "y"), (3, "z", "q")], "doc_id long, text string, __af_n string")
    assert as_rows(exact_dedup.drop_exact_duplicates(df), "doc_id", "text", "__af_n") == [(1, "a b", "x"), (3, "z", "q")]
    assert exact_dedup.exact_duplicates(nothing).count() == 0 == exact_dedup.drop_exact_duplicates(nothing).count()


def near_reference(rows, percent=75):
    sets, parent = [], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in SPACE.split(low) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def family(spark, size, seed):
    """Near copies of one text, in chains, with exact copies between."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(90)]
    rows = []
    for i in range(size):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, 89)] = f"n{i}"
        rows.append((i, " ".join(words)))
        if i % 5 == 0:
            base[rng.randint(0, 89)] = f"b{i}"
    return rows + [(1000 + i, rows[i][1]) for i in range(0, size, 4)]


def test_near_duplicates(docs):
    want = near_reference([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert as_rows(ngram_join.near_duplicate_components(docs), "doc_id", "n_shingles", "component_id") == want


def degrees(rows):
    """(id, number of other sets that the set of the id links with)."""
    least, sets = {}, {}
    for i, t in rows:
        w = [x for x in SPACE.split(t.lower()) if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        least[sets[i]] = min(i, least.get(sets[i], i))
    n = Counter(x for pair in pair_reference(rows) for x in pair[:2])
    return sorted(((i, n[least[own]]) for i, own in sets.items()), key=repr)


@pytest.mark.parametrize("block,part", [(500, 20_000), (7, 12), (1, 1)])
def test_large_families_of_near_copies(spark, monkeypatch, block, part):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "PART_ROWS", part)
    monkeypatch.setattr(ngram_join, "TOLD", 1)
    rows = family(spark, 40, 1) + [(5000 + i, t) for i, t in family(spark, 30, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ngram_join.near_duplicate_components(df).cache()
    assert as_rows(found, "doc_id", "n_shingles", "component_id") == near_reference(rows)
    assert as_rows(found, "doc_id", "n_links") == degrees(rows)


def test_sets_that_share_a_class_number_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_digest", (lambda real: lambda tokens: (real(tokens)[0] % 3, real(tokens)[1]))(ngram_join._digest))
    rows = family(spark, 20, 5)
    found = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(found, "doc_id", "n_shingles", "component_id") == near_reference(rows)


@pytest.mark.parametrize("pack", [60_000, 3])
def test_sketches_keep_every_linked_set_and_few_others(spark, monkeypatch, pack):
    monkeypatch.setattr(ngram_join, "PACK_SETS", pack)
    rng = random.Random(pack)
    alone = [" ".join(str(rng.randrange(10**6)) for _ in range(120)) for _ in range(60)]
    near = [t for _, t in family(spark, 20, 8)]
    linked = {t for i, j, *_ in pair_reference(list(enumerate(near))) for t in (near[i], near[j])}
    few = ["one", "one two three four five", "one two three four five six"]
    texts = spark.createDataFrame([(t,) for t in alone + near + few], "text string").repartition(4)
    sets = {t: next(iter(ngram_join.shingle_sets(ngram_join.pa.array([t])))) for t in {*alone, *near, *few}}
    marked, total = ngram_join._linkable(texts, {}, sum(map(len, sets.values())), 75, 5)
    held = {t for t, own in sets.items() if marked.holds(ngram_join._digest(own)[0])}
    assert linked and linked <= held
    assert len(held & set(alone)) <= 3 and total < sum(len(sets[t]) for t in [*near, *few]) + 400


def swapped(n, i, j, fill):
    """Two runs of n letters that differ in the order of four letters, two by two 256 apart."""
    one, two = [fill] * n, [fill] * n
    one[i], one[i + 256], one[j], one[j + 256] = "qzzq"
    two[i], two[i + 256], two[j], two[j + 256] = "zqqz"
    return "".join(one), "".join(two)


def test_long_words_whose_bytes_change_places(spark):
    every = [swapped(n, k, k + 512, "abcdefghij"[k % 10]) for k, n in enumerate([1000, 1300, 2500, 5000] * 6)]
    rows = [(1, " ".join(a for a, _ in every)), (2, " ".join(b for _, b in every)), (3, " ".join(a for a, _ in every) + " end")]
    found = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(found, "doc_id", "n_shingles", "component_id") == [(1, 20, 1), (2, 20, 2), (3, 21, 1)]


def test_partial_overlaps_of_rare_and_common_shingles():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.integers(5, 400)], rng.integers(0, 60))) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets]
    assert ngram_join._counts(sets, sets[10:]).tolist() == want


def test_fragments_are_ranges_of_the_order():
    rng = np.random.default_rng(3)
    tokens, magnitude = rng.integers(0, 1 << 63, 5000).astype(np.uint64) * 2, rng.integers(2, 9, 5000)
    cuts = ngram_join.Cuts(dict(zip(*np.unique(magnitude, return_counts=True))))
    parts = cuts.fragment(tokens, magnitude)[np.lexsort((tokens, magnitude))]
    assert (np.diff(parts) >= 0).all() and np.bincount(parts).min() > 1100 and len(np.bincount(parts)) == 4


def test_near_duplicates_of_nothing(nothing):
    assert ngram_join.near_duplicate_components(nothing).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = family(spark, 20, 3)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, __af_keep int")
    keep = {c for _, _, c in near_reference(rows)}
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == keep


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_only_ids_that_go_meet_the_texts(spark, monkeypatch, bound):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", bound, raising=False)
    text = "a b c d e f g h i j"
    rows = [(1, text), (2, text), (2, "other words"), (3, text), (None, text), (None, "last"), (4, None)]
    kept = ngram_join.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and ("broadcast" in plan) == (bound > 0)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], *rows[1:3], *rows[4:]], key=repr)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (300, 300), (200, 100)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = dict(found.select("node", "root").collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 100 for i in range(30)) and got[300] == 300
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert found.select(F.countDistinct("root")).first()[0] == 3


def pair_reference(rows, percent=75):
    """All links between different sets, by the smallest id of each."""
    least = {}
    for i, t in rows:
        w = [x for x in SPACE.split(t.lower()) if x]
        own = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        least[own] = min(i, least.get(own, i))
    every = sorted(least.items(), key=lambda x: x[1])
    out = []
    for k, (x, i) in enumerate(every):
        for y, j in every[k + 1 :]:
            if 100 * len(x & y) >= percent * len(x | y):
                out.append((i, j, len(x), len(y), len(x & y)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1000, 7])
def test_every_link_of_a_large_family_is_verified(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 500)}" for _ in range(90)]
    rows = [(i, " ".join([*base[: 2 * i], f"n{i}", *base[2 * i + 1 :]])) for i in range(40)]
    rows += [(500 + i, rows[i][1]) for i in range(0, 40, 4)] + [(900 + i, t) for i, t in family(spark, 30, 2)]
    want = pair_reference(rows)
    assert len(want) > 780
    found = ngram_join.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(found, "id_a", "id_b", "n_a", "n_b", "overlap") == want
