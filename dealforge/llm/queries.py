"""The registered query of each corpus operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn_dedup, decontaminate, hard_negatives, jaccard_join, kneser_ney, language_id, line_dedup, pivot_search, sentencepiece_codec, simhash_dedup, suffix_dedup, token_alignment, warc
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.digests(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.fit(table(spark, sf_dir, "documents"))
    return language_id.identify_pages(table(spark, sf_dir, "pages"), model)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(table(spark, sf_dir, "pages"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_search.usable(table(spark, sf_dir, "embeddings"))
    return pivot_search.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.roundtrip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.usable(table(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 100 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.linked_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_exact_topk": op9_exact_topk,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash": op13_simhash,
}

ORACLES = {
    "op2_ngram_jaccard": jaccard_join.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op6_substring_dedup": debruijn_dedup.ORACLE,
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages WHERE page_id IS NOT NULL),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op9_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op12_hard_negatives": hard_negatives.ORACLE,
}
