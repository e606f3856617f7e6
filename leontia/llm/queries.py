"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leontia.llm import jaccard, media, mixing, pii, quality, repeats, sentencepiece, sharding, tokenfile, toxicity
from leontia.llm.common import table


#: The key of the surrogates where the session sets none by ``spark.leontia.pii.key``; a deployment sets its own.
PII_KEY = "example key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.leontia.pii.key", PII_KEY)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_sentencepiece, op3_media_columns, op4_jaccard_join, op5_toxicity, op6_token_output, op7_mixing, op8_suffix_dedup, op9_quality_rules, op10_sharding, pipeline)}


#: All pairs of rows that share a window of five words; classes by walking the links.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS gram FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b JOIN w v ON v.r = a JOIN w z ON z.r = b WHERE c >= 0.8 * (x.n + y.n - c) AND v.doc_id IS NOT NULL AND z.doc_id IS NOT NULL),
reach(r, x) AS (SELECT r, r FROM w UNION SELECT reach.r, b FROM reach JOIN links ON a = x),
class AS (SELECT reach.r, min(v.doc_id) AS class_id FROM reach JOIN w v ON v.r = x GROUP BY reach.r),
number AS (SELECT a AS r, count(*) AS n_links, count(*) FILTER (same) AS n_same FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_same, 0) + 1 AS n_equal FROM w JOIN class USING (r) LEFT JOIN number USING (r)
"""

#: All windows of 100 bytes, told apart by their MD5; what is left is put together from the gaps between removed runs.
OP8_SQL = """
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS MATERIALIZED (SELECT r, doc_id, c, substr(h, 2 * c + 1, 1198) AS h FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - 99, 500)) AS c FROM t WHERE doc_id IS NOT NULL)),
g AS MATERIALIZED (SELECT r, doc_id, c + k AS i0, md5_number(substr(h, 2 * k + 1, 200)) AS s FROM (SELECT r, doc_id, c, h, unnest(range(0, least(500, len(h) // 2 - 99))) AS k FROM parts)),
ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS o FROM (SELECT DISTINCT doc_id FROM t)),
placed AS MATERIALIZED (SELECT r, i0, s, o * 4294967296 + i0 AS place FROM g JOIN ids USING (doc_id)),
firsts AS (SELECT s, min(place) AS f FROM placed GROUP BY s HAVING min(place) < max(place)),
later AS MATERIALIZED (SELECT r, i0 FROM placed JOIN firsts USING (s) WHERE place <> f),
starts AS (SELECT r, i0, max(i0) OVER (PARTITION BY r ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM later),
marks AS (SELECT r, i0, sum(CASE WHEN before IS NULL OR i0 > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i0) AS run FROM starts),
runs AS (SELECT r, run, min(i0) AS b, max(i0) + 100 AS e FROM marks GROUP BY r, run),
gaps AS (SELECT r, run, b, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY run) AS previous FROM runs),
cut AS (SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(substr(h, 2 * previous + 1, 2 * (b - previous)), '' ORDER BY run) AS head, max(e) AS tail FROM gaps JOIN t USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256 FROM t LEFT JOIN cut USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express.

    Not for op1 (keyed surrogates with collision rounds), op2 and op6 (merges of a tokenizer), op3 (files of a codec), op5 and op7
    (fitted models), op9 (iterated covariance estimates), op10 (DuckDB has no CRC-32) and the pipeline: brute force in tests/llm.
    """
    return {"op4_jaccard_join": OP4_SQL, "op8_suffix_dedup": OP8_SQL}
