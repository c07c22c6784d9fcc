"""Corpus pipeline: documents to token ids in five stages.

Each stage reads what its predecessor wrote. The first four return the columns
of ``documents``; the last one returns the ids and the digest of the text they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import bpe_words, mixing, pii_boost, quality_fm, simhash_trie
from gradeframe.llm.common import remove, table
from gradeframe.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, does not reject."""
    return quality_fm.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash_trie.one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii_boost.redact(docs, pii_boost.train(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that bring the sources to their target weights."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the text decoded from the ids) of every document of the mixture."""
    path = bpe_words.public_vocabulary()
    done = bpe_words.decode(bpe_words.encode(docs, path), path)
    return done.select("doc_id", "n_tokens", "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_duplicates), ("pii", personal_data),
          ("mixing sources", mixture), ("bpe", token_ids)]

#: Trained stages and fingerprints cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written as Parquet and read again.

    A stage's input is removed once its output is written; the last output stays
    for the result to read. Null texts count as empty and every stage states its
    own cases; an empty table gives an empty result.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
