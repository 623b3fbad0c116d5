"""The queries of the numbered operators and of the pipeline, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import ann, bpe, language_id, lexical_search, license_scan, line_dedup, near_dedup, packing, sharding, token_file, toxicity, whitening
from fleetlens.llm import exact_dedup as dedup


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"), k=2, percent=80)


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_verdicts(read(spark, sf_dir, "documents"))


def op6_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read(spark, sf_dir, "documents"), shards=8)


def op11_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT row_id, doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
),
sizes AS (SELECT row_id, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY row_id),
totals AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
tfs AS (SELECT row_id, term, count(*) AS tf FROM t GROUP BY row_id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
  ) GROUP BY item_id, term
),
scored AS (
  SELECT q.item_id, row_id, any_value(sizes.doc_id) AS doc_id,
    CAST(sum(c * CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM q JOIN dfs USING (term) JOIN tfs USING (term) JOIN sizes USING (row_id) CROSS JOIN totals
  GROUP BY q.item_id, row_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0
) WHERE rank <= 20
"""


def op12_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_byte_level_bpe": op4_byte_level_bpe,
        "op5_line_dedup": op5_line_dedup,
        "op6_posting_lists": op6_posting_lists,
        "op7_weak_toxicity": op7_weak_toxicity,
        "op8_bit_plane_tokens": op8_bit_plane_tokens,
        "op9_online_packing": op9_online_packing,
        "op10_ring_sharding": op10_ring_sharding,
        "op11_pair_bound_search": op11_pair_bound_search,
        "op12_crf_language_id": op12_crf_language_id,
        "op13_whitening": op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op11_pair_bound_search": OP11_SQL}
