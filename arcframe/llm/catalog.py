"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcframe.llm import bpe, divergence, exact_dedup, media, mixing, ngram_join, recurrent_lm, repeats, sharding, spelling, token_orc, toxicity, warc_index
from arcframe.llm.common import read_table, text_batches


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.round_trip(read_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; the folder's package is read where it is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_table(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_components(read_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read_table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(read_table(spark, sf_dir, "documents"))


@text_batches
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc_index": op1_warc_index,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_orc": op3_token_orc,
    "op4_ngram_join": op4_ngram_join,
    "op5_media": op5_media,
    "op6_toxicity": op6_toxicity,
    "op7_repeats": op7_repeats,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_bpe": op10_bpe,
    "op11_recurrent_lm": op11_recurrent_lm,
    "op12_divergence": op12_divergence,
    "op13_spelling": op13_spelling,
}

ORACLES = {
    "op1_warc_index": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
                   FROM documents),
             w AS (SELECT doc_id, text_sha256,
                          first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(x) DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
             w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
             c AS (SELECT row, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n FROM w GROUP BY ALL),
             k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING count(*) >= 10),
             v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
             o AS (SELECT lang, source, term, sum(c.n)::HUGEINT AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
             g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(v.total, 0) AS lang_total, coalesce((SELECT sum(n) FROM o WHERE o.lang = s.lang AND o.source = s.source), 0)::HUGEINT AS total
                   FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
             p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, (1 + (1000000000 * (coalesce(o.n, 0) + 2)) // (g.total + 2 * g.v))::HUGEINT AS p,
                          (1 + (1000000000 * (k.n + 2)) // (g.lang_total + 2 * g.v))::HUGEINT AS q
                   FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
             f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
                   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
                      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
             term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
             r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
    "op13_spelling": r"""
        WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
             d AS (SELECT run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY id, run),
             h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::BIGINT),
                          lambda c, b: list_reduce(range(0, 8), lambda y, k: xor(y >> 1, (y & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT)) AS h FROM d),
             v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, n FROM h),
             w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
             x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
             e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                   UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.rest = b.word),
             m AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM e GROUP BY word),
             f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN m USING (word)),
             p AS (SELECT word, word AS root FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.root WHERE f.form IS NOT NULL),
             z AS (SELECT p.word, p.root FROM p JOIN f ON f.word = p.root WHERE f.form IS NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word""",
}
