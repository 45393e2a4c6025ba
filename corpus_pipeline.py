"""From raw documents to packed training sequences, a written table after each stage.

Every stage but the last returns the columns of `documents`:
1. language_id: rows that are `und`, in effect texts without letters, go; `lang` becomes the prediction.
2. simhash_dedup: of texts connected by 5-word shingle similarity of 0.8 or more, the smallest doc_id stays.
3. suffix_dedup: passages of 100 bytes that occur earlier are cut from `text`.
4. mixing: documents are repeated, or left out, to reach the source weights.
5. packing: documents, repeated ones as often as they are there, are packed into sequences of 4096 tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadframe.llm import common, language_id, mixing, packing, simhash_dedup, suffix_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_dissimilar(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The tokenizer and the learned language model are beyond SQL; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        written = common.stage(stage(spark, docs, sf_dir), name)
        docs = written
    return docs
