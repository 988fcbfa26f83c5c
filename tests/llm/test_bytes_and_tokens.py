"""Repeated windows, media, tokens and BPE against brute force and the tokenizers library."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcframe.llm import bpe, fragments, media, mixing, repeats, token_orc
from arcframe.llm.catalog import vocabulary
from arcframe.llm.common import new_folder

tokenizers = pytest.importorskip("tokenizers")


def pairs(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def repeat_reference(rows, depth=200):
    windows = Counter(t[i : i + depth] for _, t in rows for i in range(len(t) - depth + 1))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if windows[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"BROADCAST_BYTES": 0, "CROWD": 1, "PACK_BYTES": 3000}, {"STRETCH": 150}])
def test_repeated_windows(docs, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(repeats, name, value)
    want = repeat_reference([(d, t.encode()) for d, t in pairs(docs)])
    found = repeats.remove_repeats(docs).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=repr) == want


def test_hash_modulo_a_prime_is_exact_arithmetic(monkeypatch):
    hasher, prime = repeats.SECOND, (1 << 61) - 1
    monkeypatch.setattr(repeats.PrimeHasher, "AT_ONCE", 64)
    edge = np.array([0, 1, prime - 1, prime - 1, 1 << 32, (1 << 32) - 1] * 40, np.uint64)
    other = np.roll(edge[::-1], 7)
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    with np.errstate(over="ignore"):
        assert [int(x) for x in hasher.times(edge, other)] == [int(x) * int(y) % prime for x, y in zip(edge, other)]
        want, held = [0], 0
        for i, letter in enumerate(data):
            held = (held + int(hasher.table[letter]) * pow(int(hasher.base), i, prime)) % prime
            want.append(held)
        prefix = hasher.prefix(data)
        assert [int(x) for x in prefix] == want
        same = hasher.strings(prefix, np.array([3, 259, 4]), np.array([203, 459, 204]))
    assert same[0] == same[1] != same[2]


def test_repeats_in_structured_texts(spark):
    """Thue-Morse and periodic texts, whose hashes modulo powers of two collide."""
    odd = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("hi"[x] for x in odd), "".join("ih"[x] for x in odd[:700]), "".join("ab"[x] * 16 for x in odd[:64]), "".join("ba"[x] * 16 for x in odd[:64])]
    texts += ["xyz" * 150, "zyx" * 90, "q" * 500, "".join("hi"[x] for x in odd[256:456]) + "tail", "a" * 199]
    rows = list(enumerate(texts))
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found), key=repr)
    assert got == repeat_reference([(d, t.encode()) for d, t in rows])


def test_no_texts(nothing):
    assert repeats.remove_repeats(nothing).count() == 0
    assert media.media_table(nothing).count() == 0
    assert bpe.round_trip(nothing, vocabulary("byte_bpe_50k.json")).count() == 0
    assert token_orc.token_table(nothing, vocabulary("word_bpe_49k.json"), 2).count() == 0
    assert mixing.mixture(nothing).count() == 0


def test_media_share_passages_and_frames_hold_many_chunks(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(600))
    texts = [" ".join([*(word() for _ in range(rng.randint(60, 400))), passage, *(word() for _ in range(60))]) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    folder = media.new_folder(spark, "media")
    manifest, places = media.store_media(df, folder)
    whole = sum(len(media.stored_form(t.encode())) for t in texts)
    stored = places.agg(F.sum("size"), F.count("digest"), F.countDistinct("digest"), F.countDistinct("pack", "at")).first()
    assert stored[1] == stored[2] and stored[3] * 8 < stored[1]
    # The shared passage is most of the text; all but its borders is stored once.
    assert stored[0] < whole - 39 * 0.5 * len(passage)
    facts = media.read_media(manifest, places, folder)
    assert {r["media_sha256"] for r in facts.collect()} == {hashlib.sha256(media.stored_form(t.encode())).hexdigest() for t in texts}


@pytest.mark.parametrize("most", [200_000, 0])
def test_media_round_trip(docs, monkeypatch, most):
    monkeypatch.setattr(media, "BROADCAST_ROWS", most)
    want = []
    for d, t in pairs(docs):
        body = t.encode()
        payload = body + b" " * (-len(body) % 192 if body else 192)
        image = b"P5\n192 %d\n255\n" % (len(payload) // 192) + payload
        want.append((d, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(payload)))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted((tuple(r[n] for n in names) for r in media.media_table(docs).collect()), key=repr) == sorted(want, key=repr)


def test_equal_passages_share_chunks(spark):
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 60_000).astype(np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, "a" * 777 + passage), (2, passage + "b"), (3, passage)], "doc_id long, text string")
    folder = new_folder(spark, "t")
    manifest, places = media.store_media(df, folder)
    every = manifest.select(F.explode("digests").alias("d")).count()
    stored = places.count()
    assert stored == places.select("digest").distinct().count() < every / 2
    assert media.read_media(manifest, places, folder).count() == 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cuts_are_certain(name):
    cut, bodies = fragments.forced_cuts(vocabulary(name)), fragments.token_bytes(vocabulary(name))
    for body in bodies.values():
        codes = np.frombuffer(body, np.uint8)
        if body[:2] != b"<|":
            assert not cut[codes[:-1], codes[1:]].any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fragments_are_encoded_once_and_held(texts, monkeypatch, name):
    """Fragments are encoded once while the table has room (but for those that lose their place at once); small tables and pools forget and give the same ids."""
    import random

    path = vocabulary(name)
    tokenizer = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgé漢\u00a0'1-") for _ in range(rng.randint(1, 22))) for _ in range(3000)]
    texts = [t or "" for t in texts] + [rng.choice([" ", "  ", "\n", ", "]).join(rng.choices(words, k=400)) for _ in range(40)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for slots, pool in ((1 << 18, 1 << 22), (16, 1 << 22), (1 << 10, 2000)):
        monkeypatch.setattr(fragments.Coder, "SLOTS", slots)
        monkeypatch.setattr(fragments.Coder, "POOL", pool)
        coder, calls = fragments.Coder(path, fragments.forced_cuts(path)), []
        make = coder.make
        coder.make = coder.long.make = lambda f: calls.append(f) or make(f)
        for _ in range(3):
            for lo in range(0, len(texts), 9):
                ids, edges = coder.ids(pa.array(texts)[lo : lo + 9])
                assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])] == want[lo : lo + 9]
        if slots == 1 << 18:
            assert len(calls) < 1.01 * len(set(calls))


def test_the_table_of_the_id_files_holds_more_rare_words():
    path = vocabulary("word_bpe_49k.json")
    cut, texts = fragments.forced_cuts(path), pa.array(["".join(f" q{i}z" for i in range(1500))])
    for slots in (1 << 8, (1 << 8) * token_orc.SLOTS // fragments.Coder.SLOTS):
        coder, calls = fragments.Coder(path, cut, slots), []
        make = coder.make
        coder.make = lambda f: calls.append(f) or make(f)  # noqa: B023
        found = [coder.ids(texts)[0].tolist() for _ in range(2)]
        assert found[0] == found[1] == tokenizers.Tokenizer.from_file(path).encode(texts[0].as_py(), add_special_tokens=False).ids
        if slots > 1 << 8:
            assert len(calls) < most - 300
        most = len(calls)


def test_bpe_is_the_library(docs):
    path = vocabulary("byte_bpe_50k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    want = []
    for d, t in pairs(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = bpe.round_trip(docs, path).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found), key=repr) == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=repr) == sorted(pairs(docs), key=repr)


def test_orc_tokens(spark, docs):
    path = vocabulary("word_bpe_49k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    rows = [(d, t) for d, t in pairs(docs) if d is not None]
    want, start = [], 0
    for d, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_orc.token_table(docs.where("doc_id is not null"), path, 2)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in found.collect()) == want
    assert token_orc.token_table(docs, path, 2).count() == docs.count()


def test_orc_filters_reach_the_files(spark, docs):
    folder = new_folder(spark, "orc")
    token_orc.write_tokens(docs, folder, vocabulary("word_bpe_49k.json"), 2)
    one = token_orc.read_tokens(spark, folder).where("doc_id = 7")
    assert one.count() == 1
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()


def test_mixture_meets_its_targets(spark):
    rows = [(i, "word " * (5 + i % 9), "en" if i % 3 else "de", f"s{0 if i % 2 else i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mixture(df).toPandas()
    cells = found.drop_duplicates(["source", "lang", "topic"])
    for margin in ("source", "lang", "topic"):
        tokens = found.groupby(margin)["n_tokens"].sum() ** mixing.POWER
        want = tokens / tokens.sum()
        assert (cells.groupby(margin)["cell_share"].sum() - want).abs().max() < 1e-3
        kept = found[found["sampled"]].groupby(margin)["n_tokens"].sum()
        assert (kept / kept.sum() - want).abs().max() < 0.05
    assert found["keep_rate"].max() == 1.0


def test_expected_tokens_meet_the_targets_by_default(spark):
    rows = [(i, "word " * (5 + i % 9), "en" if i % 3 else "de", f"s{0 if i % 2 else i % 40}") for i in range(2000)]
    found = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    for margin in ("source", "lang", "topic"):
        want = found.groupby(margin)["n_tokens"].sum() ** mixing.POWER
        kept = (found["n_tokens"] * found["keep_rate"]).groupby(found[margin]).sum()
        assert ((kept / kept.sum()) / (want / want.sum()) - 1).abs().max() < 0.005


def test_mixture_with_nulls_and_given_targets(spark, docs):
    found = mixing.mixture(docs)
    assert found.count() == docs.count() and found.where("sampled and n_tokens = 0").count() == 0
    targets = {"source": spark.createDataFrame([("s0", 3.0), ("s1", 1.0)], "source string, target double")}
    cells = spark.createDataFrame([("s0", 10), ("s1", 30), ("s2", 5)], "source string, tokens long")
    got = {r["source"]: round(r["share"], 6) for r in mixing.rake(cells, targets).collect()}
    assert got == {"s0": 0.75, "s1": 0.25, "s2": 0.0}


def test_word_counts_are_brute_force(texts):
    import re

    import numpy as np
    import pyarrow as pa

    from arcframe.llm.common import run_hashes

    plain = [t or "" for t in texts]
    words, counts = mixing.word_counts(pa.array(plain))
    for t, n, c in zip(plain, words, counts):
        parts = [x.lower() for x in re.split(rb"[\x20\x09-\x0d]+", t.encode()) if x]
        want = np.zeros(mixing.PLACES)
        for x in parts:
            if len(x) >= mixing.WORD_BYTES:
                want[int(run_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] % np.uint64(mixing.PLACES))] += 1
        assert n == len(parts) and np.allclose(c, np.log1p(want))


def test_topics_follow_the_words_of_a_text(spark):
    themes = ["ship sail harbour anchor", "bread flour oven crust", "court judge verdict appeal"]
    rows = [(i, " ".join([*themes[i % 3].split()[: 2 + i % 3], "always"] * 3)) for i in range(90)] + [(900, None), (901, "")]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r["topic"] for r in mixing.mixture(df).collect()}
    by = [{found[i] for i in range(k, 90, 3)} for k in range(3)]
    assert not (by[0] & by[1] or by[1] & by[2] or by[0] & by[2]) and found[900] == "0" == found[901]
    again = {r["doc_id"]: r["topic"] for r in mixing.mixture(df.repartition(7)).collect()}
    assert again == found
    given = mixing.mixture(df.withColumn("kind", F.col("doc_id") % 2), topic_col="kind")
    assert {r["topic"] for r in given.collect()} == {"0", "1"}


def test_topics_are_fitted_on_all_texts(spark):
    n = 4_600
    df = spark.range(n).select("id", F.concat_ws(" ", F.lit("always"), F.concat(F.lit("theme"), F.col("id") % 4), F.concat(F.lit("once"), F.col("id"))).alias("text"))
    one = mixing.fit_topics(df)
    _, counts = mixing.word_counts(pa.array([r["text"] for r in df.collect()]))
    held = (counts > 0).sum(0)
    want = np.where((held > 0) & (held <= mixing.COMMON_SHARE * n), np.log((1 + n) / (1 + held)), 0)
    assert np.allclose(one.weight, want, rtol=1e-6)
    two = mixing.fit_topics(df.repartition(5))
    assert np.array_equal(one.weight, two.weight) and np.array_equal(one.centers, two.centers)
    # the centers are the means of their own texts, all of them
    rows = counts * want
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    own = (rows @ one.centers.T).argmax(1)
    for k, center in enumerate(one.centers):
        mean = rows[own == k].sum(0)
        assert mean @ center / np.linalg.norm(mean) > 0.99


@pytest.mark.parametrize("most", [200_000, 0])
def test_raking_is_the_classic_sweep(spark, monkeypatch, most):
    import numpy as np

    monkeypatch.setattr(mixing, "RAKE_CELLS", most)

    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 100, (4, 3, 5))
    rows = [(f"s{i}", f"l{j}", str(k), int(tokens[i, j, k])) for i, j, k in np.ndindex(tokens.shape)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goals = [rng.random(n) + 0.1 for n in tokens.shape]
    goals = [g / g.sum() for g in goals]
    names = [("source", "s"), ("lang", "l"), ("topic", "")]
    targets = {m: spark.createDataFrame([(f"{p}{i}", float(x)) for i, x in enumerate(g)], f"{m} string, target double") for (m, p), g in zip(names, goals)}
    share = tokens.astype(float)
    for _ in range(300):
        for axis, g in enumerate(goals):
            other = tuple(a for a in range(3) if a != axis)
            share *= np.expand_dims(g / share.sum(axis=other), other)
    found = {(r["source"], r["lang"], r["topic"]): r for r in mixing.rake(cells, targets, tolerance=1e-9).collect()}
    assert all(abs(found[f"s{i}", f"l{j}", str(k)]["share"] - share[i, j, k]) < 1e-6 for i, j, k in np.ndindex(share.shape))
    kept = {(r["source"], r["lang"], r["topic"]): r["keep_rate"] for r in mixing.rates(cells, targets, short=0).collect()}
    ratio = share / tokens
    assert all(abs(kept[f"s{i}", f"l{j}", str(k)] - ratio[i, j, k] / ratio.max()) < 1e-3 for i, j, k in np.ndindex(share.shape))


def test_cells_that_are_kept_whole_hold_a_small_share(spark):
    cells = spark.createDataFrame([("big", 1_000_000)] + [(f"s{i}", 10 ** (i % 5)) for i in range(40)], "source string, tokens long")
    targets = {"source": mixing.flattened(cells, "source")}
    for short in (0.0, 0.02, 0.2):
        found = mixing.rates(cells, targets, short).toPandas()
        assert found["keep_rate"].max() == 1.0 and (found["keep_rate"] > 0).all()
        ratio = found["share"] / found["tokens"]
        whole = ratio[found["keep_rate"] == 1].min()
        assert found["share"][ratio > whole * (1 + 1e-9)].sum() <= short
        assert np.allclose(found["keep_rate"], np.minimum(1, ratio / whole))


def test_targets_that_cannot_be_met_are_told(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, tokens long")
    targets = {m: spark.createDataFrame(rows, f"{m} string, target double") for m, rows in (("source", [("a", 0.9), ("b", 0.1)]), ("lang", [("x", 0.5), ("y", 0.5)]))}
    assert mixing.rake(cells, targets).first()["margin_gap"] > 0.1


def test_odd_rows_of_bytes_and_tokens(spark):
    """Clashing names, repeated rows and ids, nulls."""
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "other", "y"), (None, "a b", None), (2, None, "z")]
    names = "doc_id long, text string, ids string, n_tokens string, spans string, kept string, n_bytes string, feature string, start string"
    df = spark.createDataFrame([(*r, *"uvwxyz") for r in rows], names)
    want = Counter((r[0], r[1] or "") for r in rows)
    assert Counter((r["doc_id"], r["text"]) for r in bpe.coded(df, vocabulary("byte_bpe_50k.json")).collect()) == want
    assert repeats.without_repeats(df).count() == media.media_table(df).count() == len(rows)
    found = token_orc.token_table(df, vocabulary("word_bpe_49k.json"), 2).orderBy("start").collect()
    assert len(found) == len(rows) and found[0]["start"] == 0 and [r["start"] + r["n_tokens"] for r in found[:-1]] == [r["start"] for r in found[1:]]


def test_fragments_whose_bytes_change_places(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = []
    for n, i, j in ((1200, 3, 515), (5000, 7, 4100), (300, 0, 30)):
        for four in ("qzzq", "zqqz"):
            run = ["a"] * n
            for place, letter in zip((i, i + 256, j, min(j + 256, n - 1)), four):
                run[place] = letter
            texts.append("".join(run))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokenizer = Tokenizer.from_file(path)
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    found = token_orc.token_table(df, path, 2).orderBy("doc_id").collect()
    ids = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert [r["n_tokens"] for r in found] == want and [r["ids_crc32"] for r in found] == [zlib.crc32(x) for x in ids]


def test_kept_text_and_spans_are_returned(docs):
    found = repeats.without_repeats(docs).collect()
    texts = Counter((d, t) for d, t in pairs(docs))
    got = Counter()
    for r in found:
        body, kept, at = bytes(r["kept"]), b"", 0
        source = next(t.encode() for d, t in texts if d == r["doc_id"] and len(t.encode()) == r["n_bytes"])
        for s in r["spans"]:
            kept, at = kept + source[at : s["begin"]], s["end"]
        assert body == kept + source[at:]
        got[r["doc_id"], hashlib.sha256(body).hexdigest()] += 1
    assert got == Counter((d, sha) for d, _, _, _, sha in repeat_reference([(d, t.encode()) for d, t in pairs(docs)]))


def test_pipeline_ends_with_ids_and_text(docs):
    import corpus_pipeline

    found = corpus_pipeline.tokens(docs)
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted(((d, tokenizer.encode(t, add_special_tokens=False).ids, t) for d, t in pairs(docs)), key=repr)
    assert sorted(((r["doc_id"], r["ids"], r["text"]) for r in found.collect()), key=repr) == want
