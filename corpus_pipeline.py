"""The training-data pipeline over ``documents``: quality, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, what its predecessor kept. All but the last return
rows with the columns of ``documents``. Each stage's result is written and read again before the next one.

Null texts count as empty and are judged like any other text; a packed null or empty text is its end token alone. Rows without
a doc_id are judged by the classifiers, have no near-duplicates and lose no passages. Rows of one doc_id are judged each by its
own text, stay or go together as near-duplicates, and never remove passages from each other. An empty table gives an empty
table at every stage. Other columns of documents travel along until packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomledger.llm import packing, quality, simhash, suffix_dedup, toxicity
from loomledger.llm.common import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, _labels(spark, sf_dir))


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    return toxicity.accepted(docs, _labels(spark, sf_dir))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates."""
    return simhash.representatives(docs)


def unrepeated_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has."""
    return suffix_dedup.without_repeats(docs, length=50)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 1024 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good_documents),
    ("toxicity", civil_documents),
    ("near_duplicates", distinct_documents),
    ("repeated_passages", unrepeated_texts),
    ("packing", packed_sequences),
]

#: Fitted models, components and packing have no SQL form: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
