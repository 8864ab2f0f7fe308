"""From raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import Scratch, read
from quillon.llm.language_id import language_stage
from quillon.llm.minhash_dedup import dedup_stage
from quillon.llm.packing import packing_query
from quillon.llm.quality_rules import quality_stage


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty and letterless texts, and those to which no language of the
    input gives more than half of the probability. Of texts of any length each row is judged on its own, repeated rows too;
    all columns stay, whatever their names. Without rows, or without a row that has text and lang, nothing is left."""
    return language_stage(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules judge to be of low quality (score under 0.5) go. Null texts count as empty; whole texts of any
    length, repeated rows and rows without an id are judged each; all columns stay. Without labels everything stays, with
    labels of one kind only everything goes or stays as these say; an empty input stays empty."""
    return quality_stage(docs, read(spark, sf_dir, "labels"), Scratch(spark, "quality-stage"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8) stays: the one with the smallest id, and of rows that repeat
    its id one. Texts without words link with nothing and stay, one for each id; rows without an id take part and stay behind
    those that have one. Whole texts of any length; all columns stay; an empty input stays empty."""
    return dedup_stage(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left as pieces of sequences of 2048 tokens: a row for each piece, as packing_query has them. Null
    texts count as empty and hold the end id alone; repeated rows and rows without an id are packed each; a longer document is
    cut into several pieces; an empty input gives no row."""
    return packing_query(docs, public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "packing-stage"))


STAGES = [("language ID", languages), ("quality classifier", quality), ("MinHash near-dedup", near_duplicates), ("best-fit packing", packing)]

#: No stage can be said in SQL: each rests on a trained model, hashed signatures or a search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(after, name.replace(" ", "-"))
            if last is not None:
                scratch.drop(last)
            last = docs
        else:
            docs = after
    return docs
