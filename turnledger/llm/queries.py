"""One query an operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import sql
from .bpe import encoded
from .common import table
from .exact_dedup import exact_groups
from .minhash import near_groups
from .mixing import taken_words
from .quality_fm import quality
from .quality_rules import quality_rules
from .repeats import without_repeats
from .secrets import secret_scan
from .token_counts import token_counts
from .toxicity import toxicity

MAX_TOKENS = 4096


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a candidate of all documents: doc_id, line, word, kind, value_sha256, length, score, is_secret.

    Null and empty texts have none; repeated rows are scanned each; no documents give no rows.
    """
    return secret_scan(spark, table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (above 4,096 tokens) of every whole text.

    Null and empty texts have no tokens; repeated rows are counted each; no documents give no rows.
    """
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts["n_tokens"] > MAX_TOKENS)


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.3 or more) of every whole text, null and empty ones too.

    Learns from labels outside the held-out fold alone; without any every score is 0.5. No documents give no rows.
    """
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no ids; repeated rows are encoded each; no documents give no rows.
    """
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more) of every whole text, null and empty ones too.

    Learns from labels outside the held-out fold alone; without any every score is 0.5. No documents give no rows.
    """
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Null texts count as empty, and empty texts as equal; a null doc_id comes after all others; of repeated rows one is
    kept. No documents give no rows.
    """
    return exact_groups(spark, table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards of its uses, of every row.

    Null and empty texts have size 0 and nothing is taken of them; a null source is the last one; repeated rows are
    documents of their own. No documents give no rows.
    """
    return taken_words(spark, table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the statistics, removed_words, base_failed, kept, left_sha256 of every row.

    Null and empty texts have no words and fail; a null source is a host of its own; repeated rows are judged alike. No
    documents give no rows.
    """
    return quality_rules(spark, table(spark, sf_dir, "documents")).drop("row_id")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, links from a similarity of 0.85.

    Null and empty texts are linked with nothing; rows that share a doc_id are one document; a row without one stays. No
    documents give no rows.
    """
    return near_groups(spark, table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts are empty, and texts of under 100 bytes lose nothing; repeated rows follow each other, null doc_ids come
    last. No documents give no rows.
    """
    return without_repeats(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_counts, op3_quality_fm, op4_bpe, op5_toxicity, op6_exact_dedup, op7_mixing, op8_quality_rules, op9_minhash,
        op10_suffix_dedup,
    )
}
ORACLE_SQL = {"op6_exact_dedup": sql.EXACT_DEDUP, "op8_quality_rules": sql.QUALITY_RULES}
