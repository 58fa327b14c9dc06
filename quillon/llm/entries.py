"""The queries of this subpackage, by the names under which they are registered, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, logbilinear, maxscore, mixing, quality, secrets, sharding, simhash, suffixes, warc
from .common import documents


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.resharded(documents(spark, sf_dir), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op3_logbilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.score_documents(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), size=3, bits=2)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality.judge_documents(documents(spark, sf_dir), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return maxscore.search(vectors, F.col("vec_id") % 100 == 0, 10)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir), repetition=1.5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_maxscore": OP7_SQL, "op10_warc": OP10_SQL}


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS t FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(h) AS n, sha1(h) AS digest FROM p),
w AS (SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM w
"""
