"""Byte-pair encoding and decoding with a contiguous rank array.

A word is held as its part boundaries and the ranks of its adjacent pairs, both
contiguous. The array is scanned for its minimum (the leftmost of equal ones),
the boundary there is deleted, and the two neighbouring ranks are looked up
again, until no pair has a rank. For short words that beats any linked
structure, and it vectorises: all words of one length form a matrix, a row a
word, and each step takes the minimum of every row at once. Words of over
``SHORT`` bytes, for which a scan a merge would cost the square of the length,
use a heap over a linked list; both give the same merges.

Only distinct words of a batch are encoded. Texts are normalised and cut into
words here for ASCII and Latin letters, where every version of Unicode agrees,
and by the library's own normaliser and pre-tokeniser otherwise, which get the
text as it is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SHORT = 48
#: Text that one step holds as words; a batch of larger texts is taken in several steps.
STEP_CHARS = 1_000_000
NONE = np.iinfo(np.int32).max
ENCODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
])


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    at = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class RankArrayBPE:
    """Encoder and decoder of a ``tokenizers`` file with byte-level words and an end-of-word mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        names = {v: k for k, v in self.vocab.items()}
        names |= {v: k for k, v in self.special.items()}
        self.names = [names.get(k, "") for k in range(max(names) + 1)]
        alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = np.array([self.vocab[c] for c in alphabet], dtype=np.int32)
        self.last = np.array([self.vocab[c + end] for c in alphabet], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.width = len(self.names)
        self._table()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.spaces = regex.compile(r"\s+")

    def _table(self) -> None:
        """An open-addressing table of pairs, so that many lookups are a few gathers."""
        size = 1 << max(4, (4 * len(self.pairs)).bit_length())
        self.mask, self.shift = size - 1, 64 - size.bit_length() + 1
        keys = np.full(size, -1, dtype=np.int64)
        ranks, made = np.full(size, NONE, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.probes = 1
        for (a, b), (rank, new) in self.pairs.items():
            key, step = a * self.width + b, 1
            at = int(self._slot(np.array([key], dtype=np.int64))[0])
            while keys[at] >= 0:
                at, step = (at + 1) & self.mask, step + 1
            keys[at], ranks[at], made[at] = key, rank, new
            self.probes = max(self.probes, step)
        self.keys, self.ranks, self.made = keys, ranks, made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; ``NONE`` where a pair has no merge, or a part is missing (-1)."""
        shape = a.shape
        a, b = a.ravel(), b.ravel()
        key = a.astype(np.int64) * self.width + b
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        held = self.keys[at]
        hit = held == key
        rank, new = np.where(hit, self.ranks[at], NONE), np.where(hit, self.made[at], 0)
        open_ = np.flatnonzero(~hit & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == key[open_]
            rank[open_[hit]], new[open_[hit]] = self.ranks[at[open_[hit]]], self.made[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return rank.reshape(shape), new.reshape(shape)

    def _short(self, block: np.ndarray) -> list[np.ndarray]:
        """Words of one length in bytes, a row each."""
        n, width = block.shape
        parts = self.inner[block]
        parts[:, -1] = self.last[block[:, -1]]
        size = np.full(n, width)
        done: list = [None] * n
        live = np.arange(n)
        if width > 1:
            rank, new = self._find(parts[:, :-1], parts[:, 1:])
        else:
            rank = new = np.zeros((n, 0), dtype=np.int32)
        while True:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(live), dtype=np.int64)
            over = rank[np.arange(len(live)), best] == NONE if rank.shape[1] else np.ones(len(live), dtype=bool)
            if over.any():
                for k in np.flatnonzero(over):
                    done[live[k]] = parts[k, : size[k]]
                keep = ~over
                live, parts, rank, new, size, best = live[keep], parts[keep], rank[keep], new[keep], size[keep], best[keep]
            if not len(live):
                return done
            row = np.arange(len(live))
            parts[row, best] = new[row, best]
            # delete the boundary: all that stands behind it moves up by one place
            cols = np.arange(parts.shape[1] - 1)
            moved = cols[None, :] + (cols[None, :] > best[:, None])
            parts = np.take_along_axis(parts, moved, axis=1)
            tail = cols[None, :] >= (size - 1)[:, None]
            parts[tail] = -1
            size = size - 1
            kept = cols[:-1]
            moved = kept[None, :] + (kept[None, :] >= best[:, None])
            rank, new = np.take_along_axis(rank, moved, axis=1), np.take_along_axis(new, moved, axis=1)
            # refresh the ranks on both sides of the new part
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
                if len(ok):
                    rank[ok, at[ok]], new[ok, at[ok]] = self._find(parts[ok, at[ok]], parts[ok, at[ok] + 1])

    def _long(self, data: bytes) -> np.ndarray:
        part = self.inner[np.frombuffer(data, dtype=np.uint8)].tolist()
        part[-1] = int(self.last[data[-1]])
        n, get = len(part), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], k, part[k], part[k + 1], r[1]) for k in range(n - 1) if (r := get((part[k], part[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            right = after[k]
            if part[k] != a or right < 0 or part[right] != b:
                continue
            part[k], part[right] = new, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (r := get((part[left], part[after[left]]))):
                    heapq.heappush(heap, (r[0], left, part[left], part[after[left]], r[1]))
        return np.array([p for p in part if p >= 0], dtype=np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; a word is a string without white space, as the pre-tokeniser cuts it."""
        data = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        out: list = [None] * len(data)
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            if width > SHORT:
                found = [self._long(data[k]) for k in at]
            else:
                found = self._short(np.frombuffer(b"".join([data[k] for k in at]), dtype=np.uint8).reshape(len(at), width))
            for k, ids in zip(at.tolist(), found):
                out[k] = ids
        return out

    def _normal(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        # up to there all characters are composed already, and Unicode has not changed them since
        if max(text) < "ʰ" and "İ" not in text and "\x85" not in text:
            return self.words.findall(text.lower())
        text = self.library.normalizer.normalize_str(text)
        return [bytes(self.bytes_of[c] for c in word).decode("utf-8") for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def cut(self, text: str) -> list[str]:
        """Words of a text, and the special strings in it, which stand for themselves."""
        if not self.specials or not self.specials.search(text):
            return self._normal(text)
        words, at = [], 0
        for found in self.specials.finditer(text):
            words += [*self._normal(text[at : found.start()]), found.group()]
            at = found.end()
        return words + self._normal(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids in a row, where each text's ids end, and the decoded texts."""
        cut = [self.cut(text) for text in texts]
        number = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        if not number.sum():
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64), [""] * len(texts)
        flat = pa.chunked_array([pa.array(words, pa.string()) for words in cut if words]).combine_chunks().dictionary_encode()
        index, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
        plain = [w for w in distinct if w not in self.special]
        coded = dict(zip(plain, self.encode_words(plain)))
        ids = [np.array([self.special[w]], dtype=np.int32) if w in self.special else coded[w] for w in distinct]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        start = np.cumsum(size) - size
        pool = np.concatenate(ids).astype(np.uint32)
        each = size[index]
        end = np.cumsum(each)
        at = np.arange(end[-1]) + np.repeat(start[index] - (end - each), each)
        ends = np.concatenate([[0], end])[np.cumsum(number)]
        spelled = [self.decode(x) for x in ids]
        words_end = np.cumsum(number)
        decoded = [" ".join([spelled[k] for k in index[e - n : e].tolist()]) for n, e in zip(number.tolist(), words_end.tolist())]
        return pool[at], ends, decoded

    def decode(self, ids) -> str:
        """What the library's decode gives where a file names no decoder: the parts with spaces between."""
        names = self.names
        return " ".join([names[k] for k in ids])


def steps(texts: list[str], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= chars:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 digests of ids and of the decoded text; with ``keep`` also ids and decoded.

    Ids are those of the tokenizers library without added special tokens,
    truncation or padding; special strings inside a text are their own ids, as
    is its default. Null and empty texts give no ids and an empty decoded text;
    a text of any length is encoded whole. Repeated rows are encoded each; an
    empty table gives an empty result; other columns are not looked at.
    """
    more = [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())] if keep else []
    schema = T.StructType([*ENCODED.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = RankArrayBPE(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in steps(texts):
                ids, ends, decoded = coder.encode(texts[first:last])
                ids = ids.astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                columns = [
                    batch.column(0).slice(first, last - first), pa.array(ends - begins, pa.int64()),
                    pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(begins, ends)]),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded]),
                ]
                if keep:
                    columns += [pa.array([ids[a:b].astype(np.int64) for a, b in zip(begins, ends)], pa.list_(pa.int64())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(run, schema)
