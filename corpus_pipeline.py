"""A corpus pipeline: from raw documents to packed training sequences.

Each stage gets the documents its predecessor kept, from Parquet. The first three return the columns of documents; a
document's text changes only where shared passages are cut out. Nulls, empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from redactrail.llm import chunk_dedup, near_dedup, packing, quality
from redactrail.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of this corpus, doesn't reject."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the least doc_id."""
    return near_dedup.deduplicated(docs)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages that occur in several of them left in the first only."""
    return chunk_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_quality), ("near-dedup", drop_near_copies), ("substring dedup", cut_shared_passages), ("best-fit packing", pack)]

#: Learned scores, sampled candidates and rolling hashes are not for SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
