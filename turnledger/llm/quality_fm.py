"""Document quality by a factorisation machine.

Features are hashed words, structure statistics in bins, and what is known of a
text as a record (its length in bytes and characters). Each has a weight and a
short vector; all pairs interact through the products of their vectors, and
the sum over pairs is had in linear time as half the square of the sum less
the sum of the squares, for each factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import MAX_LABELLED, Words, fitted, scored, sums

WORD_BITS = 16
BINS = 24
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 8, 512, 0.02, 1e-5
THRESHOLD = 0.3
SYMBOLS, PUNCTUATION, DIGITS = b"#*$%&|<>", b".,;:!?", b"0123456789"
CAPITALS = bytes(range(65, 91))
SPACES = b" \t\n\x0b\x0c\r"
#: Statistics that ``structure`` gives, and with them the number of features.
STATISTICS = 14
FEATURES = (1 << WORD_BITS) + STATISTICS * BINS


def structure(text: bytes) -> list[int]:
    """One bin for each statistic; an empty text is in the first bin of all."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n, size, distinct = len(words), len(text), len(set(words))
    of = lambda kind: size - len(text.translate(None, kind))
    letters = size - of(SPACES)
    part = lambda a, b, most=1.0: a / b / most if b else 0.0
    continued = of(bytes(range(0x80, 0xC0)))
    values = [
        np.log2(1 + n) / 16, np.log2(1 + size) / 20, part(distinct, n), part(letters, n, 16.0),
        part(of(SYMBOLS), letters, 0.25), part(of(PUNCTUATION), n), part(of(DIGITS), letters, 0.25), part(of(CAPITALS), letters),
        part(len(lines), n, 0.25), part(len(lines) - len(set(lines)), len(lines)), part(text.count(b"!"), n),
        part(sum(a == b for a, b in zip(words, words[1:])), n), part(max(map(len, lines), default=0), size), np.log2(1 + size - continued) / 20,
    ]
    return [int(min(max(v, 0.0), 0.999) * BINS) for v in values]


def rows_of(texts: list[bytes], reader: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each text: columns, values, ends. Words have values that square to 1 in all; bins have 1."""
    text, word = reader.of(texts)
    column = (word >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    number = np.bincount(text, minlength=len(texts))
    value = 1 / np.sqrt(np.maximum(number, 1))[text]
    binned = np.array([structure(t) for t in texts], dtype=np.int64).reshape(len(texts), STATISTICS)
    binned += (1 << WORD_BITS) + np.arange(STATISTICS) * BINS
    row = np.concatenate([text, np.repeat(np.arange(len(texts)), STATISTICS)])
    order = np.argsort(row, kind="stable")
    column = np.concatenate([column, binned.ravel()])[order]
    value = np.concatenate([value, np.ones(binned.size)])[order]
    return column, value, np.cumsum(number + STATISTICS)


class FactorisationMachine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors, self.reader = bias, weights, factors, None

    def margins(self, column: np.ndarray, value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the sums of vectors that they came by."""
        moved = self.factors[column] * value[:, None]
        total = sums(moved, ends)
        squares = sums(np.einsum("ij,ij->i", moved, moved), ends)
        return self.bias + sums(self.weights[column] * value, ends) + 0.5 * (np.einsum("ij,ij->i", total, total) - squares), total

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        self.reader = self.reader or Words()
        return 1 / (1 + np.exp(-np.clip(self.margins(*rows_of(texts, self.reader))[0], -30, 30)))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Words()
    for batch in batches:
        column, value, ends = rows_of(batch.column(2).to_pylist(), reader)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(column.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
        ], names=["label_id", "label", "columns", "values"])


def fit(rows: pd.DataFrame, seed: int = 5) -> FactorisationMachine:
    """Adaptive gradient steps over shuffled batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    machine = FactorisationMachine(0.0, np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, RANK)))
    label = rows["label"].to_numpy(dtype=np.float64)
    if not len(label):
        machine.factors[:] = 0
        return machine
    columns, values = rows["columns"].to_numpy(), rows["values"].to_numpy()
    mean = (label.sum() + 1) / (len(label) + 2)
    machine.bias = float(np.log(mean / (1 - mean)))
    seen = np.full((FEATURES, RANK + 1), 1e-8)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            column = np.concatenate(columns[some]).astype(np.int64)
            value = np.concatenate(values[some]).astype(np.float64)
            size = np.fromiter((len(columns[k]) for k in some), dtype=np.int64, count=len(some))
            margin, total = machine.margins(column, value, np.cumsum(size))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[some]) / len(some)
            machine.bias -= RATE * error.sum() * 10
            each = np.repeat(error, size) * value
            own = machine.factors[column]
            grad = np.column_stack([each, each[:, None] * (np.repeat(total, size, axis=0) - own * value[:, None])])
            names, inverse = np.unique(column, return_inverse=True)
            order_ = np.argsort(inverse, kind="stable")
            summed = np.add.reduceat(grad[order_], np.searchsorted(inverse[order_], np.arange(len(names))), axis=0)
            held = np.column_stack([machine.weights[names], machine.factors[names]])
            summed += DECAY * held
            seen[names] += summed**2
            held -= RATE * 5 * summed / np.sqrt(seen[names]) * (0.5 ** (epoch / 3))
            machine.weights[names], machine.factors[names] = held[:, 0], held[:, 1:]
    return machine


def quality(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Learns from ``labels.quality`` of rows outside the held-out fold, at most
    about ``most`` of them, a doc_id that repeats with its smallest text. Null
    texts are empty; an empty text has the score of its bins; a text of any
    length is scored whole. Without labels every score is 0.5. Repeated rows
    are scored each; an empty table gives an empty result; other columns are
    not looked at.
    """
    machine = fitted(docs, labels, "quality", featured, "label_id long, label int, columns array<int>, values array<float>", fit, most)
    return scored(docs, machine, threshold)
