"""Registered queries of the corpus operators and, where SQL can say it, what they must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

import corpus_pipeline

from .common import Scratch, read
from .embedding_dedup import near_duplicates as near_vectors
from .exact_search import top_k
from .language_id import language_query
from .minhash_dedup import dedup_query
from .packing import packing_query
from .piece_sampling import sampling_query
from .quality_rules import quality_query
from .rans_store import store_query
from .sharding import assign
from .toxicity import toxicity_query


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"), Scratch(spark, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_query(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "packing"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_query(read(spark, sf_dir, "documents"))


def op5_rans_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_query(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark, "store"))


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"), Scratch(spark, "sharding"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "quality"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling_query(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), Scratch(spark, "search"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_rans_store": op5_rans_store,
    "op6_lpt_sharding": op6_lpt_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
    "pipeline": corpus_pipeline.run,
}

#: Exact search as a join of the queries with all rows; the other operators rest on models, hashes, searches or files.
ORACLE: dict[str, str] = {
    "op9_exact_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
