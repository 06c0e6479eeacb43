"""Token counts: batches of texts go to the tokenizer, and only lengths come back.

Texts arrive as Arrow batches. A long text is split at safe boundaries: a
single space between two ASCII letters or digits, where no piece of the
vocabulary can cross, as every piece has its word marks at its start; the
space is left out and the library's own leading mark takes its place. The
pieces of all texts are then packed into calls of about equal bytes, so that
one long document neither blocks a call nor swells its memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: Characters from which a text is split, and bytes that one call encodes.
SPLIT_CHARS = 16_384
CALL_BYTES = 1 << 20
BOUNDARY = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
])


def pieces_are_prefixed(model) -> bool:
    """Whether the word mark stands only at the start of pieces, or alone in runs."""
    mark = "▁"
    return not any(mark in p.lstrip(mark) for p in map(model.id_to_piece, range(model.get_piece_size())))


def split(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Parts of at least ``size`` characters whose token counts add up to the text's."""
    parts, start = [], 0
    while len(text) - start > size:
        found = BOUNDARY.search(text, start + size)
        if not found:
            break
        parts.append(text[start : found.start()])
        start = found.end()
    parts.append(text[start:])
    return parts


def counted(model, texts: list[str], call_bytes: int = CALL_BYTES) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), dtype=np.int64)
    parts, owner, held = [], [], 0

    def flush() -> None:
        nonlocal parts, owner, held
        if parts:
            np.add.at(out, owner, [len(ids) for ids in model.encode(parts, num_threads=1)])
        parts, owner, held = [], [], 0

    for k, text in enumerate(texts):
        for part in split(text):
            parts.append(part)
            owner.append(k)
            held += len(part) if part.isascii() else len(part.encode())
            if held >= call_bytes:
                flush()
    flush()
    return out


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; null texts count as empty, which have no tokens.

    ``model_path`` is a sentencepiece model that every executor can read. A
    text of any length is counted whole, and special strings in it are plain
    text. Repeated rows are counted each; an empty table gives an empty result;
    other columns are not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if not pieces_are_prefixed(model):
            raise ValueError("this vocabulary has pieces that cross a space")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counted(model, texts), pa.int64())], names=TOKENS.names
            )

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return own.mapInArrow(count, TOKENS)
