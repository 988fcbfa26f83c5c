"""WARC index, toxicity, sharding, the pipeline and the SQL oracles."""

from __future__ import annotations

import random

import pytest
from support import SF, same
from pyspark.sql import functions as F

from arcframe.llm import catalog, sharding, toxicity, warc_index


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_archive_with_odd_pages(spark):
    rows = [(1, "http://www.a.com/x?y#z", "h" * 200), (2, "https://b.org", "h" * 200), (3, None, None), (None, "http://a.com/x", "h" * 200)]
    rows += [(5, "http://a.com/x y", "short"), (6, "http://a.com/x y", "short"), (7, "q\tw", "é" * 60), (8, "q", "é" * 60), (8, "q", "é" * 60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_index.round_trip(df).collect()), key=repr)
    want = [(1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (None, 200, "revisit", 1), (5, 5, "response", None), (6, 5, "response", None)]
    want += [(7, 120, "response", None), (8, 120, "revisit", 7), (8, 120, "revisit", 7)]
    assert got == sorted(want, key=repr)
    assert warc_index.round_trip(df.limit(0)).count() == 0


def test_lookups_find_all_lines_of_a_key_over_blocks(spark, monkeypatch):
    from arcframe.llm.common import new_folder

    monkeypatch.setattr(warc_index, "BLOCK_LINES", 3)
    lines = [(f"k{i % 7:02d}", "f", i, 1) for i in range(50)]
    folder = new_folder(spark, "index")
    shards = warc_index.write_index(spark.createDataFrame(lines, warc_index.CAPTURES).coalesce(1), folder)
    found = warc_index.lookup(spark.createDataFrame([("k03",), ("k00",), ("none",), ("a",)], "key string"), shards, folder)
    assert sorted((r["key"], r["at"]) for r in found.collect()) == sorted((k, at) for k, _, at, _ in lines if k in ("k03", "k00"))


def test_grammar_weighs_context():
    tables, lexicon = toxicity.composed(), toxicity.default_grammar().lexicon()
    score = lambda *texts: toxicity.evidence(list(texts), lexicon, tables).tolist()
    plain, aimed, denied, told, calm = score("an idiot", "you idiot", "not an idiot", "he said idiot", "the sea is calm. no")
    assert aimed > plain > 5 * denied > 0 and told < aimed and calm == 0
    assert score("not. an idiot") == [plain]
    verb, weak, meant, wished, denied = score("they burn wood", "burn you", "we will burn you", "I hope you die", "we will never burn you")
    assert verb == 0 < denied < weak < meant == wished
    assert score("shut up", "up shut", "you piece of trash")[:2] == [1.5, 0.0] and score("go go to hell") == [1.5]


def clause_scores(words, stems):
    """The grammar's rules over one clause, by looking back from each word."""
    kinds = ["insult" if w in stems else toxicity.word_class(w) if w not in toxicity.INSULTS.split() else "other" for w in words]
    listed = [tuple(p.split()) for p in toxicity.PHRASES]
    at = 0
    for i in range(len(words)):  # a phrase begins anew behind the one before
        if any(i + 1 - len(p) >= at and tuple(words[i + 1 - len(p) : i + 1]) == p for p in listed):
            kinds[i], at = "phrase", i + 1
    marks = []
    for i, kind in enumerate(kinds):
        denied = any(k == "negation" for k in kinds[max(0, i - 3) : i])
        marks.append("-" * denied + '"' * ("report" in kinds[:i]) if kind in toxicity.SCOPED else "")
    out, seen = [], None  # seen: the last part of a threat, (kind, mark, place)
    for i, kind in enumerate(kinds):
        if seen and i - seen[2] > 3:
            seen = None
        part = (kind, marks[i])
        if kind in ("intent", "wish"):
            part, seen = ("other", ""), (kind, marks[i], i)
        elif kind == "threat":
            part, seen = ("other", ""), ("meant" if seen and seen[0] == "intent" else "verb", marks[i], i)
        elif kind == "death":
            hit = seen and seen[0] in ("wish", "intent")
            part, seen = ("menace", marks[i]) if hit else ("other", ""), None if hit else seen
        elif kind == "target" and seen and seen[0] in ("verb", "meant"):
            part, seen = ("menace" if seen[0] == "meant" else "weak", seen[1]), None
        out.append(part)
    total, last = 0.0, None
    for i, (kind, mark) in enumerate(out):
        near = last[0] if last and i - last[1] <= 4 else ""
        if kind == "target":
            total, last = total + 0.3 * (near == "insult"), ("target", i)
        elif kind in ("insult", "phrase", "menace", "weak"):
            base = {"insult": stems.get(words[i], 1.0) * (1.3 if near == "target" else 1.0), "phrase": 1.5 * stems.get(words[i], 1.0), "menace": 2.0, "weak": 0.4}[kind]
            total, last = total + base * toxicity.MARKS[mark], ("target" if kind in ("menace", "weak") else "insult", i)
    return total


def test_composed_transducers_follow_the_rules():
    rng = random.Random(9)
    stems = toxicity.default_grammar().stems
    words = ["other", "words", *(w for c in toxicity.CLASSES.values() for w in c.split()[:3]), "idiot", "trash", *"piece of trash shut up go to hell".split()]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += [f"{rng.choice(texts)}. {rng.choice(texts)}" for _ in range(300)]
    want = [sum(clause_scores(c.split(), stems) for c in t.split(".")) for t in texts]
    assert toxicity.evidence(texts, toxicity.default_grammar().lexicon(), toxicity.composed()) == pytest.approx(want)


def test_both_labels_and_repeated_ids_are_settled(spark):
    docs = spark.createDataFrame([(i % 7, f"some text {i % 5} badword{i % 2}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(7)] + [(i, 1) for i in range(3)], "doc_id long, toxic int")
    one, two = (toxicity.score_documents(docs.repartition(n), labels).groupBy("doc_id").agg(F.sum("score").alias("s")).orderBy("doc_id").collect() for n in (1, 5))
    assert [r["s"] for r in one] == pytest.approx([r["s"] for r in two])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = catalog.read_table(spark, sf, "documents"), catalog.read_table(spark, sf, "labels")
    judged = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = judged[judged["toxic"] == 1]
    assert (toxic["predicted"] == 1).mean() > 0.85
    assert (judged[judged["toxic"] == 0]["predicted"] == 0).mean() > 0.96
    assert judged["score"].between(0, 1).all()


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_every_labelled_row_is_learned_from(spark, monkeypatch, bound):
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", bound, raising=False)
    rows = spark.range(22_000).withColumnRenamed("id", "doc_id").where(~toxicity.held_out())
    last = rows.orderBy(F.desc(F.xxhash64(F.col("doc_id").cast("string")))).limit(1_000).withColumn("toxic", F.lit(1))
    labels = rows.join(last, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic")).localCheckpoint()
    assert labels.count() > 17_000
    word = F.when(F.col("toxic") == 1, "zorgblat").otherwise("plain")
    grammar = toxicity.fitted(labels.select("doc_id", F.concat(word, F.lit(" line "), "doc_id").alias("text")), labels)
    assert grammar.stems.get("zorgblat", 0) > 2 and "plain" not in grammar.stems


def test_clean_rows_count_only_stems_that_can_be_picked(spark, monkeypatch):
    words = lambda i: f"{i} Common halved zorgblat{' solitary' * (i < 15)}" if i % 5 == 0 else f"{i} Common other zorgblat{'' if i % 7 else 's'}"
    rows = spark.createDataFrame([(words(i), int(i % 5 == 0), i // 5 % 2) for i in range(200)], "text string, label int, half int").localCheckpoint()
    sent, every = [], toxicity._stem_counts
    monkeypatch.setattr(toxicity, "_stem_counts", lambda wanted=None: sent.append(wanted) or every(wanted))
    found = {}
    for bound in (200_000, 0):
        monkeypatch.setattr(toxicity, "SENT_STEMS", bound)
        found[bound] = {r["stem"]: tuple(r)[1:] for r in toxicity._counts(rows).collect()}
    assert sent[1] and sent[3] is None and "zorgblat" in sent[1] and not {"soli*", "solitary", "othe*", "other"} & sent[1]
    assert found[200_000] == {s: c for s, c in found[0].items() if s in found[200_000]}
    assert {"", "zorgblat", "zorg*", "common", "halved"} <= set(found[200_000]) and found[0]["zorgblat"] == found[200_000]["zorgblat"]
    assert found[200_000][""] == (80, 20, 80, 20)


def test_every_stage_begins_with_a_collected_heap(spark, docs):
    import corpus_pipeline

    def full() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    for name, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs.where("doc_id < 3"), "/root/testdata/sf0.001")
        assert full() > before, name


def test_rare_words_are_told_by_their_heads():
    lexicon = toxicity.Grammar({"zorgbl*": 3.0, "kilometer": 2.0}).lexicon()
    assert [lexicon[w] for w in ("Zorgblat", "zorgb", "KILOMETER", "kill", "STÄDTE", "of", "U")] == [
        ("insult", 3.0), ("other", 0.0), ("insult", 2.0), ("threat", 0.0), ("other", 0.0), ("other:of", 0.0), ("target", 0.0),
    ]
    lexicon.LIMIT = 3
    for _ in range(2):
        assert all(lexicon[f"zorgblat{'x' * i}"] == ("insult", 3.0) for i in range(100))


def test_scores_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(10)], "doc_id long, toxic int, quality int")
    none = labels.limit(0)
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    assert toxicity.score_documents(docs, none).where("score is null").count() == 0
    assert toxicity.score_documents(nothing, none).count() == 0
    clash = docs.withColumn("score", F.lit("s")).withColumn("x", F.lit(1))
    assert toxicity.drop_toxic(clash, none).columns == clash.columns
    rows = [(i, f"you are a stupid idiot and a moron, number {i}" if i % 3 == 0 else f"a plain line, number {i}" if i % 3 == 1 else None, "s", i) for i in range(700)]
    many = spark.createDataFrame(rows, "doc_id long, text string, score string, x int").coalesce(1)
    assert sorted(map(tuple, toxicity.drop_toxic(many, none).collect())) == [r for r in rows if r[0] % 3]


def test_shards_are_even_and_gapless(spark, docs, nothing):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "é" * rng.randint(0, 400)) for i in range(4000)], "doc_id long, text string")
    found = sharding.shard_documents(df).toPandas()
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() / sizes.mean() < 1.01
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard")["slot"])
    assert sharding.shard_documents(docs).count() == docs.count()
    assert sharding.shard_documents(nothing).count() == 0


def test_shard_columns_and_repeated_ids(spark):
    import zlib

    rng = random.Random(3)
    texts = ["é" * rng.randint(0, 300) + str(i) for i in range(3000)]
    rows = [(7 if i % 3 == 0 else i, None if i == 5 else texts[i % 400]) for i in range(3000)] + [(None, "x")] * 40
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(found["doc_id"].fillna(-1).astype(int), found["size"], found["text_crc32"])) == want
    sizes = found.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() / sizes.mean() < 1.05 and set(found["law"]) == {"bytes"} and found["grown_shard"].isna().all()
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
        assert (own.sort_values("slot")["virtual_slot"].diff().dropna() >= 0).all()


def test_rebalancing_edits_the_map():
    sizes = [random.Random(i).randint(1, 100) for i in range(200)]
    first = sharding.first_map(8, 200)
    second = sharding.rebalance(first, sizes, 8)
    load = [sum(s for s, o in zip(sizes, second) if o == k) for k in range(8)]
    assert max(load) - min(load) <= 2 and sum(a == b for a, b in zip(first, second)) > 100
    assert sharding.rebalance(second, sizes, 8) == second


def pipeline_reference(rows):
    """Rows after the exact and near duplicate stages, by brute force."""
    from test_exact_and_near import exact_reference, near_reference

    kept = {r[0] for r in exact_reference(rows) if r[3]}
    left = [(i, t) for i, t in rows if i in kept]
    return {c for _, _, c in near_reference(left)}


def test_pipeline_stages(spark, docs, nothing):
    import corpus_pipeline

    odd = docs.where("doc_id is not null").withColumn("size", F.lit(1)).withColumn("__af_row", F.lit("a")).withColumn("id", F.lit(2))
    now, sizes = odd, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == odd.columns, name
        sizes.append({r["doc_id"] for r in now.collect()})
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] in sizes[0]]
    assert sizes[0] == {r["doc_id"] for r in odd.collect()}
    assert sizes[2] == pipeline_reference(rows) and sizes[3] <= sizes[2]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name


@pytest.mark.parametrize("rows,want", [("10000", 2_048), ("0", 2_048), ("500", 500)])
def test_pipeline_stages_bound_the_rows_of_a_batch(spark, docs, rows, want):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[1:3]:
            spark.conf.set(key, rows)
            stage(spark, docs, SF)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
