"""The corpus pipeline: from ``documents`` to encoded documents of the mix, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnledger.llm.bpe import encoded
from turnledger.llm.common import table, written
from turnledger.llm.exact_dedup import deduplicated
from turnledger.llm.minhash import distinct_documents
from turnledger.llm.mixing import mixed
from turnledger.llm.quality_rules import passing

#: Similarity of 5-word shingles from which documents are near-duplicates, in per cent.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and frequent lines of the others."""
    return passing(spark, docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return deduplicated(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return distinct_documents(spark, docs, NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    return mixed(spark, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids, and digest of the decoded text, for each use of a document."""
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("minhash_near_dedup", near_dedup), ("mixing", mixing), ("bpe", encoding),
]

#: The near-duplicate, mixing and encoding stages cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
