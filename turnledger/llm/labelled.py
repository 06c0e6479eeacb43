"""Labelled rows for the classifiers, and words of texts as numbers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .minhash import word_hashes

#: Labelled rows that a classifier is fitted on at most, give or take a sampling error; more are sampled by a hash of doc_id.
MAX_LABELLED = 16_000
FOLDS = 5
_SEED = 77


class Words:
    """Hashes of the words of many texts: runs of letters, digits and bytes of other scripts, A-Z lowered."""

    def __init__(self):
        self.plain = bytes(
            c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in b"'" else 32 for c in range(256)
        )

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words: index of the text, hash of the word; in the order of texts."""
        words = [t.translate(self.plain).split() for t in texts]
        word = word_hashes([w for own in words for w in own])
        text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        order = np.lexsort((word, text))
        text, word = text[order], word[order]
        if not len(text):
            return text, word
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])])
        return text[new], word[new]


def sampled(labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(label_id, label) of labelled rows outside the held-out fold, about ``most`` of them if there are more."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(folds=FOLDS))
    own = own.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64(F.lit(_SEED), "label_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return own


def fitted(docs: DataFrame, labels: DataFrame, label: str, features: Callable, schema: str, fit: Callable, most: int = MAX_LABELLED):
    """What ``fit`` makes of the features of the sampled rows.

    ``features`` maps batches of (label_id, label, text as bytes) to ``schema``
    where the texts are; ``fit`` runs in one task, which a bounded number of
    rows reaches, in the order of label_id, so fits agree. Only the model comes
    to the driver.
    """
    small_batches(docs.sparkSession)
    chosen = F.broadcast(sampled(labels, label, most))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), text).join(chosen, "label_id")
    # of a doc_id that repeats the smallest text, so that fits agree whatever the order of rows
    rows = rows.groupBy("label_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            pdf = pa.Table.from_batches(held).to_pandas().sort_values("label_id", kind="stable").reset_index(drop=True)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pdf))], pa.binary())], names=["model"])

    found = rows.select("label_id", "label", "text").mapInArrow(features, schema).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit(pd.DataFrame({name.split()[0]: [] for name in schema.split(", ")}))


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float, step: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``score`` sees nothing but texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            out, a, held = [], 0, 0
            for k, text in enumerate(texts):
                held += len(text)
                if held >= step or k == len(texts) - 1:
                    out.append(score(texts[a : k + 1]))
                    a, held = k + 1, 0
            values = np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array((values >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds=FOLDS).alias("held_out"), text)
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` (rows) that end at ``ends``; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]
