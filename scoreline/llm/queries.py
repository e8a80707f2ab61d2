"""The registered queries of this subpackage over the given tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import (
    bpe_codec, decontaminate, language_id, lm, quality_rules, simhash, spelling, suffix_dedup, token_counts,
    toxicity, warc, weak_labels, whitening,
)


#: Bytes of a segment in op10: some quarter of the given pages are longer.
PAGE_SEGMENT = 1 << 12


def vocabulary_path() -> str:
    """The given vocabulary file, the same place on every machine."""
    import public_tokenizers

    return os.environ.get("BPE_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digests(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.weak_quality(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"), segment=PAGE_SEGMENT)
    broken = F.raise_error(F.concat(F.lit("a record can't be read: "), F.col("problem"))).cast("string")
    digest = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(broken)
    return found.withColumn("payload_digest", digest).drop("problem")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_lm_scores, op3_quality_rules, op4_simhash, op5_suffix_dedup, op6_toxicity,
        op7_bpe_codec, op8_weak_quality, op9_decontamination, op10_warc, op11_language_id, op12_whitening,
        op13_spelling_variants, pipeline,
    )
}

#: The other operators can't be stated in SQL; tests hold them against brute force.
ORACLE_SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
bits AS (SELECT *, list_aggregate(list_transform(generate_series(1, 40), lambda i:
             right('000' || bin(strpos('0123456789abcdef', hex[i]) - 1), 4)), 'string_agg', '') AS b FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(generate_series(0, 31), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(generate_series(1, 5), lambda j:
               CAST(b[i * 5 + j] AS INTEGER) * (1 << (5 - CAST(j AS INTEGER)))))::INTEGER]), 'string_agg', '')
           AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits""",
    "op5_suffix_dedup": """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, b, octet_length(b) AS n, hex(b) AS h FROM docs),
starts AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w
           FROM sized, unnest(generate_series(0, n - 200)) AS t(i)),
often AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY w) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200
                                    OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new
           FROM often),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
cut AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last,
               string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS front
        FROM gaps JOIN sized USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM sized LEFT JOIN cut USING (doc_id)""",
    "op13_spelling_variants": """
WITH RECURSIVE
crc AS (SELECT list_transform(generate_series(0, 255), lambda i: list_reduce(list_prepend(i, generate_series(1, 8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
found AS (SELECT id, unnest(regexp_extract_all(s, '[a-zÀ-ÿ]+')) AS run FROM low),
runs AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS b FROM found
         WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(
                      generate_series(0, length(b) // 2 - 1), lambda i:
                      16 * (strpos('0123456789ABCDEF', b[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', b[2 * i + 2]) - 1)),
                  lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM runs, crc),
left_over AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                          ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM left_over WHERE length(word) >= 7
          GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest
        FROM words, unnest(generate_series(0, length(word) - 1)) AS t(p)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
         UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS most,
                arg_min(other, (-o.n, encode(other))) AS first FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN first END AS form,
                 CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM forms
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)""",
}
