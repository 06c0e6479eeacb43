"""Toxicity by a counterfactually regularised classifier.

A logistic model over the distinct words of a text. Every labelled sentence
with an identity term has counterfactuals: the sentence with the term swapped
for each other term of its family, and the sentence without it, which is its
fixed neutral form. The squared change of the score from the sentence to each
of them is a part of the loss. So a term that happens to stand in toxic
sentences cannot carry a score by itself: where nothing else speaks for
toxicity the score stays near 1 / sqrt(2 SWAP), whatever the labels say, and
neutral mentions of a group are not flagged; where other words speak, the
swaps change nothing and cost nothing. Words that explain nothing are brought
to zero by an absolute penalty (proximal steps with momentum), so long texts do
not gather noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import MAX_LABELLED, Words, fitted, scored, sums

#: Families of identity terms; a term is swapped for the others of its family, and left out.
FAMILIES = (
    ("women", "men", "woman", "man", "girls", "boys", "female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "muslims", "christians", "jews"),
    ("black", "white", "asian", "african", "latino", "hispanic", "european", "arab"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "nigerian", "turkish", "immigrant", "immigrants"),
    ("disabled", "blind", "deaf", "elderly", "young", "old", "poor", "rich"),
)
MIN_TEXTS = 3
#: Words enter by their likelihood ratio against the label (about 1 in 10,000 by chance at 15), and identity terms in any case.
MIN_RATIO = 15.0
#: Weights of the penalties: absolute, squared, and counterfactual (a sentence's mean over its swaps and its neutral form).
SPARSE, RIDGE, SWAP = 2e-4, 1e-5, 50.0
ROUNDS = 200
THRESHOLD = 0.5


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias, self.reader = words, weights, bias, Words()

    def margins(self, text: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        if not len(self.words):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        hit = self.words[at] == word
        return self.bias + np.bincount(text[hit], weights=self.weights[at[hit]], minlength=n)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.margins(*self.reader.of(texts), len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Words()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        text, word = reader.of(texts)
        ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(word.view(np.int64)))],
            names=["label_id", "label", "words"],
        )


def likelihood_ratio(hits: np.ndarray, times: np.ndarray, positive: float, n: int) -> np.ndarray:
    """Twice the log likelihood ratio of each word's two-by-two table."""
    total = np.zeros(len(times))
    for seen, row, column in (
        (hits, times, positive), (times - hits, times, n - positive),
        (positive - hits, n - times, positive), (n - positive - times + hits, n - times, n - positive),
    ):
        expected = np.maximum(row * column / n, 1e-12)
        total += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-12) / expected), 0)
    return total


class Counterfactuals:
    """Swapped and term-free forms of sentences: their score is that of the sentence with one weight out and one in."""

    def __init__(self, row: np.ndarray, column: np.ndarray, families: list[np.ndarray], width: int, n: int, swap: float):
        """``row`` and ``column`` are the words of all sentences, ``families`` columns of terms; column ``width`` stands for no word."""
        has = set(zip(row.tolist(), column.tolist()))
        pairs: list[tuple[int, int, int, float]] = []
        for family in families:
            for k in np.flatnonzero(np.isin(column, family)):
                i, out = int(row[k]), int(column[k])
                # a term that stands there already adds nothing, as words count once
                others = [width if (i, int(b)) in has else int(b) for b in family if b != out]
                pairs.append((i, out, width, swap / 2 if others else swap))
                pairs += [(i, out, b, swap / 2 / len(others)) for b in others]
        self.row, self.out, self.into = (np.array([p[k] for p in pairs], dtype=np.int64) for k in range(3))
        self.cost, self.width, self.n = np.array([p[3] for p in pairs]), width, n

    def scores(self, weights: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, ...]:
        own = np.append(weights, 0.0)
        s, t = sigmoid(margin[self.row]), sigmoid(margin[self.row] - own[self.out] + own[self.into])
        return s - t, s * (1 - s), t * (1 - t)

    def loss(self, weights: np.ndarray, margin: np.ndarray) -> float:
        return float((self.cost * self.scores(weights, margin)[0] ** 2).sum()) / self.n

    def spread(self, part: np.ndarray, s_slope: np.ndarray, t_slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``part`` a pair moves: the margins of sentences, and weights directly."""
        margins = np.bincount(self.row, weights=part * (s_slope - t_slope), minlength=self.n)
        direct = np.bincount(self.out, weights=part * t_slope, minlength=self.width + 1) - np.bincount(self.into, weights=part * t_slope, minlength=self.width + 1)
        return margins / self.n, direct[:-1] / self.n

    def along(self, weights: np.ndarray, margin: np.ndarray, s_slope: np.ndarray, t_slope: np.ndarray) -> np.ndarray:
        """The change of each score difference along a direction of weights and margins."""
        own = np.append(weights, 0.0)
        return s_slope * margin[self.row] - t_slope * (margin[self.row] - own[self.out] + own[self.into])


def fit_words(rows: pd.DataFrame, sparse: float = SPARSE, ridge: float = RIDGE, swap: float = SWAP, families=FAMILIES) -> Model:
    """The model from rows of label and words (hashes, each once)."""
    label = rows["label"].to_numpy(dtype=np.float64)
    lists = [np.asarray(w, dtype=np.int64).view(np.uint64) for w in rows["words"]]
    if not len(label) or not any(map(len, lists)):
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0 if not len(label) else float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))))
    every = np.concatenate(lists)
    size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    words, column, times = np.unique(every, return_inverse=True, return_counts=True)
    terms = [np.array([Words().of([t.encode()])[1][0] for t in family], dtype=np.uint64) for family in families]
    named = np.unique(np.concatenate(terms)) if terms else np.zeros(0, dtype=np.uint64)
    hits = np.bincount(column, weights=np.repeat(label, size), minlength=len(words))
    used = ((times >= MIN_TEXTS) & (likelihood_ratio(hits, times, label.sum(), len(label)) >= MIN_RATIO)) | np.isin(words, named)
    words = np.union1d(words[used], named)
    if not len(words):
        return Model(words, np.zeros(0), float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))))
    place = np.minimum(np.searchsorted(words, every), len(words) - 1)
    use = words[place] == every
    column = place[use]
    row = np.repeat(np.arange(len(lists)), size)[use]
    n, width = len(label), len(words)
    swaps = Counterfactuals(row, column, [np.searchsorted(words, family) for family in terms], width, n, swap)
    ends = np.searchsorted(row, np.arange(n), side="right")
    margins = lambda w, b: b + sums(w[column], ends)

    def slopes(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        margin = margins(w, b)
        error = (sigmoid(margin) - label) / n
        change, s_slope, t_slope = swaps.scores(w, margin)
        more, direct = swaps.spread(2 * swaps.cost * change, s_slope, t_slope)
        error = error + more
        return np.bincount(column, weights=error[row], minlength=width) + direct + ridge * w, float(error.sum())

    # a step of the inverse of the steepest curvature (power iteration on the words' matrix)
    probe = np.ones(width) / np.sqrt(width)
    for _ in range(12):
        probe = np.bincount(column, weights=sums(probe[column], ends)[row], minlength=width).astype(np.float64)
        top = np.linalg.norm(probe)
        probe /= top or 1.0
    steep = max((np.bincount(x, weights=swaps.cost, minlength=width + 1)[:-1].max() for x in (swaps.out, swaps.into) if len(x)), default=0.0)
    step = 1 / (0.25 * (top + n) / n + ridge + steep / n)
    weights, bias, ahead, bias_ahead, momentum = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(ROUNDS):
        slope, bias_slope = slopes(ahead, bias_ahead)
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * sparse, 0)
        new_bias = bias_ahead - step * bias_slope
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - weights)
        bias_ahead = new_bias + (momentum - 1) / following * (new_bias - bias)
        weights, bias, momentum = new, new_bias, following
    # what is left is fitted again on its own, without the absolute penalty's pull towards zero
    return refitted(words, weights, bias, row, column, label, swaps, min(ridge, 0.05 / n))


def refitted(words, weights, bias: float, row, column, label, swaps: Counterfactuals, ridge: float, rounds: int = 25) -> Model:
    """Newton steps (conjugate directions within each, a shorter one where the loss would grow) on the words that are left."""
    n, width = len(label), len(words)
    kept = weights != 0
    use = kept[column]
    row, column = row[use], column[use]
    theta = np.append(weights, bias)
    free = np.append(kept, True)

    def margin(v: np.ndarray) -> np.ndarray:
        return v[-1] + np.bincount(row, weights=v[:-1][column], minlength=n)

    def back(e: np.ndarray, direct: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, weights=e[row], minlength=width) + direct, e.sum()) * free

    def loss(v: np.ndarray) -> float:
        m = margin(v)
        return float(np.mean(np.logaddexp(0, m) - label * m)) + swaps.loss(v[:-1], m) + ridge / 2 * float(v[:-1] @ v[:-1])

    now = loss(theta)
    for _ in range(rounds):
        m = margin(theta)
        p = sigmoid(m)
        change, s_slope, t_slope = swaps.scores(theta[:-1], m)
        more, direct = swaps.spread(2 * swaps.cost * change, s_slope, t_slope)
        slope = back((p - label) / n + more, direct) + ridge * np.append(theta[:-1], 0)
        curve = np.maximum(p * (1 - p), 1e-6) / n

        def apply(v: np.ndarray) -> np.ndarray:
            mv = margin(v)
            part = 2 * swaps.cost * swaps.along(v[:-1], mv, s_slope, t_slope)
            rest, own = swaps.spread(part, s_slope, t_slope)
            return back(curve * mv + rest, own) + ridge * np.append(v[:-1], 0) + 1e-9 * v

        move, rest = np.zeros(width + 1), -slope
        way, size = rest.copy(), rest @ rest
        for _ in range(30):
            if size < 1e-14:
                break
            along = apply(way)
            rate = size / (way @ along)
            move += rate * way
            rest = rest - rate * along
            following = rest @ rest
            way, size = rest + following / size * way, following
        length = np.abs(move).max()
        move *= min(1.0, 2.0 / max(length, 1e-12))
        while (then := loss(theta + move)) > now and length > 1e-6:
            move, length = move / 2, length / 2
        if then > now:
            break
        theta, done = theta + move, now - then < 1e-9
        now = then
        if done:
            break
    return Model(words[kept], theta[:-1][kept], float(theta[-1]))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Learns from ``labels.toxic`` of rows outside the held-out fold, at most
    about ``most`` of them, a doc_id that repeats with its smallest text. Null
    texts are empty; a text without words has the score of the bias; a text of
    any length is scored whole. Without labels every score is 0.5. Repeated
    rows are scored each; an empty table gives an empty result; other columns
    are not looked at.
    """
    model = fitted(docs, labels, "toxic", featured, "label_id long, label int, words array<long>", fit_words, most)
    return scored(docs, model, threshold)
