"""The recurrent language model, the divergence audit and spelling variants, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arcframe.llm import divergence, gru, recurrent_lm, spelling

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd(docs, texts):
    """docs once more with repeated rows and columns that clash with names in use."""
    from pyspark.sql import functions as F

    return docs.unionByName(docs.where("doc_id < 9")).withColumn("word", F.lit("w")).withColumn("row", F.lit(1)).withColumn("n", F.lit("n")).withColumn("id", F.lit(0)).withColumn("term", F.lit(0))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# Spelling


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out = {}
    for w, n in words.items():
        found = [x for x in words if x != w and near(w, x)]
        best = min(found, key=lambda x: (-words[x], x)) if found else None
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, n, len(found), None if form is None else words[form]]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: tuple(x) for w, x in out.items()}


def variant_rows(spark):
    rng = random.Random(4)
    roots = ["schlafen", "ééàüßö", "aaaaaaa", "aaaaaab", "working", "z" * 300]
    texts = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = rng.choice(roots)
            for _ in range(rng.choice((0, 0, 0, 0, 0, 0, 1, 1, 2, 3))):
                at = rng.randrange(len(w) - 1)
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + rng.choice("aeé") + w[at:], w[:at] + "x" + w[at + 1 :]))
            words += [w.upper() if rng.random() < 0.1 else w] * rng.choice((1, 1, 3))
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, texts[3]), (61, ""), (62, "_".join(["schlafen1"] * 3)), (63, "x" * 30_000 + " " + "y" * 40_000)]
    rows += [(64 + i, "q" * 9000 + " " + "q" * 9001 * (i % 2)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_variants_match_brute_force(spark):
    df = variant_rows(spark)
    got = {r["word"]: (r["form"], r["n"], r["n_near"], r["form_n"], r["root"]) for r in spelling.variants(odd(df, None)).collect()}
    want = brute_variants(rows_of(df) + [r for r in rows_of(df) if r[0] is not None and r[0] < 9])
    assert got == want
    assert sum(x[0] is not None for x in want.values()) > 5 and any(x[0] and x[0] != x[4] for x in want.values())
    assert spelling.variants(df.limit(0)).count() == 0


def test_keys_are_those_of_the_distinct_deletions():
    words = ["abcabc", "aaaaaa", "ééé", "q" * 500]
    owner, keys = spelling.delete_keys(words)
    assert [int((owner == i).sum()) for i in range(4)] == [7, 2, 2, 2]
    _, other = spelling.delete_keys(["aaaaa", "bcabc", "abcab"])
    assert set(other[:1]) <= set(keys[owner == 1]) and set(other[1:3]) <= set(keys[owner == 0])


# Divergence


def brute_divergence(rows):
    terms, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(UP) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        terms[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        own = {s: [terms[lang, s][t] for t in kept] for g, s in groups if g == lang}
        share = lambda counts: [1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(kept)) for c in counts]
        p = {s: share(c) for s, c in own.items()}
        q = share([sum(c[i] for c in own.values()) for i in range(len(kept))])
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(map(gap, p[s], p[o])), o.encode(), o) for o in own if o != s))
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            best = sorted((-gap(p[s][i], q[i]), t.encode(), t) for i, t in enumerate(kept) if own[s][i] > 0 and p[s][i] > q[i])[:10]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,tile", [(2048, 128), (7, 2)])
def test_divergence_matches_brute_force(spark, block, tile):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdéÀ漢🙂") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["A-B", "C3PO", "\x00x"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None]), f"s{min(6, int(rng.expovariate(0.4)))}") for _ in range(200)]
    rows += [(None, "en", None), (None, None, None), ("alone", "xx", "a"), ("", "xx", "b"), ("same same", "yy", "c")] + [rows[0]] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.divergence(df.withColumnRenamed("text", "term"), "term", block, tile)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_divergence(rows)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_divergence_moves_packed_counts(spark):
    """Its tables have rows by tasks, owners and groups, not one for each group and term; more owners make no more sums of pairs."""
    from pathlib import Path

    from arcframe.session import shared_dir

    rng = random.Random(3)
    usual = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    rare = lambda i: "".join(chr(97 + int(c)) for c in f"{i:09d}")
    rows = [(" ".join([*rng.sample(usual, 20), *(rare(100 * i + j) for j in range(50))]), "en", f"s{i % 6}") for i in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    folder, width = Path(shared_dir(spark).removeprefix("file://")), spark.conf.get("spark.sql.shuffle.partitions")
    before = set(folder.glob("arcframe-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        got = divergence.divergence(df)
        assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_divergence(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    made = {p.name.split("-")[1]: spark.read.parquet(str(p)) for p in set(folder.glob("arcframe-*")) - before}
    assert made["terms"].count() <= 2 * (32 + 6)
    assert made["partial"].where("part = 'pair'").count() == 15


def test_counts_of_slices_and_rounds_match_regex(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    words = ["".join(rng.choice("abYZéÀ漢🙂") for _ in range(rng.randint(1, 9))) for _ in range(50)] + ["x" * 300, "x" * 299 + "y"]
    texts = ["".join(rng.choice([*words, " ", "-", "3", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", "end", "", "start", ""]
    group = np.array([rng.randrange(3) for _ in texts])
    names = [("en", "a"), ("en", "b"), ("de", "a")]
    want, docs = Counter(), Counter()
    for text, g in zip(texts, group):
        found = Counter(t.translate(UP) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text))
        want.update({(*names[g], t): n for t, n in found.items()})
        docs.update((names[g][0], t) for t in found)
    held = [divergence.counted(pa.array([t.encode() for t in texts], pa.large_binary()).slice(lo, 40), group[lo : lo + 40]) for lo in range(0, len(texts), 40)]
    pieces = list(divergence.pieces_of(held, names, 3))
    assert sum(p["counts"] for p in pieces) == len(want)
    for counts in (1 << 22, 7):
        monkeypatch.setattr(divergence, "ROUND_COUNTS", counts)
        got, blocks = {}, {}
        for owner in range(3):
            for row in divergence.kept_counts(pa.Table.from_pylist([p for p in pieces if p["owner"] == owner]), 3, 4):
                body = divergence.unpacked(row["body"])
                terms = [t.decode() for t in body.column("term").to_pylist()]
                assert terms == sorted(terms, key=str.encode) and row["total"] == sum(body.column("n").to_pylist())
                assert max(body.column("col").to_pylist()) < row["width"] <= 4
                got |= {(row["lang"], row["source"], t): n for t, n in zip(terms, body.column("n").to_pylist())}
                blocks.setdefault((row["lang"], row["block"]), (row["width"], set()))[1].update(zip(body.column("col").to_pylist(), terms, body.column("lang_n").to_pylist()))
        assert got == {k: n for k, n in want.items() if docs[k[0], k[2]] >= 10}
        assert all(len(found) == width for width, found in blocks.values())
        assert len({(lang, t) for (lang, _), (_, found) in blocks.items() for _, t, _ in found}) == sum(w for w, _ in blocks.values())
        assert all(m == sum(n for (g, _, u), n in want.items() if (g, u) == (lang, t)) for (lang, _), (_, found) in blocks.items() for _, t, m in found)


def test_shares_are_exact_beyond_doubles():
    counts = np.array([0, 1, 2**40 + 1, 3 * 10**15], np.int64)
    total = int(counts.sum())
    assert divergence.shares(counts, np.int64(total), 4).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]


# Language model


def brute_base(rows):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UP)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, own in words if not held(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    score = lambda own: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
    return sorted(((i, held(i), len(own), sum(counts[w] > 0 for w in own), n, round(score(own), 6)) for i, own in words), key=repr)


@pytest.mark.parametrize("lookup,tokens", [(1 << 17, 4096), (40, 20), (0, 4)])
def test_base_scores_match_brute_force(spark, docs, texts, monkeypatch, lookup, tokens):
    monkeypatch.setattr(recurrent_lm, "LOOKUP", lookup)
    monkeypatch.setattr(recurrent_lm, "TOKENS", tokens)
    rows = odd(docs, texts)
    got = recurrent_lm.score_documents(rows).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=repr) == brute_base(rows_of(rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(50)], "doc_id long, text string")
    assert recurrent_lm.score_documents(df.limit(0)).count() == 0
    held = df.where(recurrent_lm.fold("doc_id") == 1)
    got = recurrent_lm.score_documents(held).collect()
    assert got and {(r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 9)) for r in got} == {(3, 0, 0, 0.0)}


def network(tokens=30, seed=3):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 500, tokens))[::-1] + 0.5
    bounds = gru.class_bounds(counts, 5)
    weights = gru.fresh(counts, bounds)
    return rng, counts, bounds, weights


def test_untrained_network_is_the_unigram_model():
    rng, counts, bounds, weights = network()
    texts = [np.append(rng.integers(1, 30, n), 0) for n in (0, 1, 5, 100)]
    want = [np.log(counts / counts.sum())[t].sum() for t in texts]
    assert np.allclose(gru.Network(weights, bounds).scores(texts), want, rtol=1e-5)


def test_probabilities_sum_to_one_and_windows_change_nothing():
    rng, counts, bounds, weights = network()
    for k in ("to_class", "to_token"):
        weights[k] = weights[k] + rng.normal(0, 0.3, weights[k].shape).astype(np.float32)
    net = gru.Network(weights, bounds)
    prefix = rng.integers(1, 30, 9)
    with_next = net.scores([np.append(prefix, t) for t in range(30)])
    assert np.isclose(np.exp(with_next - net.scores([prefix])[0]).sum(), 1, rtol=1e-4)
    texts = [rng.integers(1, 30, n) for n in (70, 3, 31, 0, 33)]
    assert np.allclose(net.scores(texts), net.scores(texts, steps=4), rtol=1e-5)
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], rtol=1e-5)


def test_gradients_match_differences(monkeypatch):
    rng, counts, bounds, weights = network(12)
    weights = {k: x.astype(np.float64) + (rng.normal(0, 0.3, x.shape) if k.startswith("to_") else 0) for k, x in weights.items()}
    net = gru.Network({k: x.copy() for k, x in weights.items()}, bounds)
    stream = rng.integers(0, 12, 200)
    monkeypatch.setattr(gru, "LEAST_LANES", 1)
    monkeypatch.setattr(gru, "LEAST_WINDOWS", 1 << 20)
    monkeypatch.setattr(gru, "STEPS", 200)
    read = np.append(0, stream[:-1])
    cuts = np.flatnonzero(read == 0)[1:]
    loss = lambda w: -sum(gru.Network(w, bounds).scores(np.split(stream, cuts))) / len(stream)
    seen = {k: np.zeros_like(x) for k, x in weights.items()}
    net.train(stream, seen)
    for name in gru.NAMES:
        for at in list(np.ndindex(weights[name].shape))[:: max(1, weights[name].size // 7)]:
            moved = {k: x.copy() for k, x in weights.items()}
            moved[name][at] += 2e-2
            up = loss(moved)
            moved[name][at] -= 4e-2
            want = (up - loss(moved)) / 4e-2
            assert abs(abs(want) - np.sqrt(seen[name][at])) < 2e-3 + 0.02 * abs(want)


def test_training_beats_the_unigram_model_on_held_out_text(spark):
    rng = random.Random(2)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(300):
        w, out = rng.randrange(40), []
        for _ in range(rng.randint(5, 120)):
            w = rng.choice(follow[w])
            out.append(f"w{w}")
        rows.append((i, " ".join(out)))
    got = recurrent_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)
    assert len(got) > 40 and sum(r["score"] < r["base_score"] for r in got) < len(got) / 10
