"""A pipeline from raw documents to token shards, in five stages.

Each stage gets the documents that its predecessor kept, as a Parquet table, and returns those it keeps; the last
writes token shards and returns a digest of each document as read back from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, language_id, mixing, ngram_join, token_shards
from corpusloom.llm.common import shared_dir, stash, table
from corpusloom.llm.queries import BYTE_BPE, PIECES


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the model learns from the labels of docs."""
    return language_id.keep_identified(docs, PIECES)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    return ngram_join.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the token shards."""
    path = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    token_shards.write_shards(docs, BYTE_BPE, path)
    return token_shards.documents(token_shards.read_shards(spark, path))


STAGES = [
    ("language-id", identified),
    ("ngram-jaccard-join", distinct),
    ("benchmark-decontamination", decontaminated),
    ("mixing-sources", mixed),
    ("token-shards", tokenized),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
