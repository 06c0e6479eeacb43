"""Repeated passages by merging Burrows-Wheeler transforms of shards.

A byte goes if it lies in a 100-byte string that also starts earlier, in a
smaller doc_id or before it in the same document.

1. Each start of a 100-byte string is dealt to its minimiser: the leftmost of
   the smallest hashes of the 37-byte grams in it. Equal strings have the same
   minimiser at the same place, so strings can only repeat among the starts of
   one minimiser; neighbouring starts with one minimiser form a context, the
   bytes their strings span. No pair of equal strings is missed.
2. Contexts that are equal as a whole, known by 128 bits of the SHA-256 digest of
   their bytes, are folded together, first in each batch of texts and then in the
   shuffle by minimiser: all but the first of them repeat. A passage in a third
   of all documents so leaves one row a batch.
3. Different contexts of one minimiser may share some strings and not others.
   Their bytes, the minimiser's gram as one symbol, are gathered by minimiser
   in bounded chunks and dealt to shards. Each shard has the transform of its
   strings over an alphabet of 8-grams, which are numbered by their bytes. The
   transforms are merged by refining their interleave: each round reads all
   transforms in the present order, sorts stably by symbol, and so orders
   suffixes by eight symbols more; boundaries between blocks of equal prefixes
   carry over, which are the common prefixes. After eight rounds the blocks hold
   the starts of equal strings; the suffixes of the shards themselves are never
   sorted again. In a block all starts but the first repeat.
4. A minimiser with very many different contexts, as at the edge of a passage
   that a part of all documents share, is split before the merge: its starts by
   halves of the places that the gram can have in a string, and by the bytes that
   all strings of a half have around the gram. Equal strings stay together, and
   the parts are folded and counted like contexts; what is still too large is
   halved again. At one place a part is a single string, which is folded, so
   every part comes to fit.
5. The runs of repeated starts go to their documents, whose covered bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, written

LENGTH = 100
GRAM = 37
#: Symbols of a string whose gram is one symbol; symbols that one round adds.
DEPTH, STEP = LENGTH - GRAM + 1, 8
INDEX_BITS = 24
SEGMENT = 1 << 22
CHUNK_SYMBOLS = 60_000
SHARDS = 4
#: Different contexts of one minimiser that are merged as they are; those of a larger one are split first.
MERGE_CONTEXTS = 1_000
LAST = (1 << 63) - 1

_RANDOM = np.random.default_rng(10)
_LETTERS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window, by doubling."""
    least, span = x, 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    return np.minimum(least[: len(x) - width + 1], least[width - span :]) if width > span else least


def digests(parts: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits by which contexts (bytes, and the place of the gram in them) are known."""
    sha = hashlib.sha256
    both = np.frombuffer(b"".join([sha(x).digest()[:16] for x in parts]), dtype=np.uint64).reshape(-1, 2)
    return both[:, 0] ^ mixed(place.astype(np.uint64) + _M[0]), both[:, 1]


class Contexts:
    """Cuts texts into contexts."""

    def __init__(self):
        self._powers(1 << 17)

    def _powers(self, n: int) -> None:
        one = np.ones(1, dtype=np.uint64)
        self.power = np.concatenate([one, np.cumprod(np.full(n, _BASE))])
        self.inverse = np.concatenate([one, np.cumprod(np.full(n, _INVERSE))])

    def of(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each segment: hash of the minimiser, digest of the context (two parts), first start, number of starts, place of the gram."""
        for base in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
            data = np.frombuffer(text[base : base + SEGMENT + LENGTH - 1], dtype=np.uint8)
            n = len(data)
            if n >= len(self.power):
                self._powers(n)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTERS[data] * self.power[:n])])
            gram = mixed((total[GRAM:] - total[:-GRAM]) * self.inverse[: n - GRAM + 1])
            low = np.uint64((1 << INDEX_BITS) - 1)
            placed = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
            at = (window_minima(placed, LENGTH - GRAM + 1) & low).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.append(first[1:], len(at))
            place = at[first] - first
            number = last - first
            parts = [text[i:j] for i, j in zip((first + base).tolist(), (last + base + LENGTH - 1).tolist())]
            yield gram[at[first]], *digests(parts, place), first + base, number, place


FOUND = "h long, c0 long, c1 long, id long, lo int, n int, place int, more_id array<long>, more_lo array<int>"


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different contexts of each batch at their first place, with their other places."""
    cutter = Contexts()
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        texts = batch.column(1).to_pylist()
        parts, owner = [], []
        for k in np.argsort(ids, kind="stable").tolist():
            for part in cutter.of(texts[k]):
                parts.append(part)
                owner.append(np.full(len(part[0]), ids[k], dtype=np.int64))
        if not parts:
            continue
        h, c0, c1, lo, n, place = (np.concatenate(x) for x in zip(*parts))
        owner = np.concatenate(owner)
        order = np.argsort(c0, kind="stable")
        a, b = c0[order], c1[order]
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        size = np.diff(np.append(begin, len(order)))
        first = order[begin]
        rest = np.ones(len(order), dtype=bool)
        rest[begin] = False
        others = order[rest]
        offsets = pa.array(np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            pa.array(h[first].view(np.int64)), pa.array(c0[first].view(np.int64)), pa.array(c1[first].view(np.int64)), pa.array(owner[first]),
            pa.array(lo[first].astype(np.int32)), pa.array(n[first].astype(np.int32)), pa.array(place[first].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(owner[others])), pa.ListArray.from_arrays(offsets, pa.array(lo[others].astype(np.int32))),
        ], names=["h", "c0", "c1", "id", "lo", "n", "place", "more_id", "more_lo"])


class Strings:
    """Symbols of the contexts of a chunk; strings are read in circles, which no start of interest reaches."""

    def __init__(self, texts: list[bytes], place: np.ndarray, group: np.ndarray):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        start = np.cumsum(size) - size
        cut = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(cut, start + place + 1, 1)
        np.add.at(cut, start + place + GRAM, -1)
        symbol = data.astype(np.uint64)
        symbol[start + place] = 256 + group.astype(np.uint64)
        symbol = symbol[np.cumsum(cut[:-1]) == 0]
        self.size = (size - (GRAM - 1)).astype(np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        self.offset = np.arange(len(symbol), dtype=np.int32) - self.start[self.owner]
        # 8-grams are numbered exactly: symbols, then pairs of numbers at distance 1, 2 and 4
        names, code = np.unique(symbol, return_inverse=True)
        for step in (1, 2, 4):
            names, code = np.unique(code * np.int64(len(names)) + code[self.shifted(step)], return_inverse=True)
        self.code = code.astype(np.uint16 if len(names) <= 1 << 16 else np.int32)
        self.before = self.shifted(-STEP)

    def shifted(self, by: int) -> np.ndarray:
        return self.start[self.owner] + (self.offset + by) % self.size[self.owner]


def transform(strings: Strings, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffixes in the order of their first symbols, and the symbol (8-gram) before each: its transform."""
    suffixes = own
    for _ in range(DEPTH // STEP):
        suffixes = strings.before[suffixes]
        suffixes = suffixes[np.argsort(strings.code[suffixes], kind="stable")]
    return suffixes, strings.code[strings.before[suffixes]]


def merge(shards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all shards in order, and the block of equal prefixes of each, from the transforms alone.

    Holds the interleave (the shard of each place). A round reads the shards'
    transforms in the order of the interleave and sorts that stably; where
    symbols or the blocks before differ, a new block begins.
    """
    weave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s) for s, _ in shards])
    block = np.zeros(len(weave), dtype=np.int32)
    symbol = np.empty(len(weave), dtype=shards[0][1].dtype)
    for _ in range(DEPTH // STEP):
        for k, (_, letters) in enumerate(shards):
            symbol[weave == k] = letters
        order = np.argsort(symbol, kind="stable")
        weave, moved, held = weave[order], symbol[order], block[order]
        fresh = (moved[1:] != moved[:-1]) | (held[1:] != held[:-1])
        block = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(fresh, dtype=np.int32)])
    suffix = np.empty(len(weave), dtype=np.int32)
    for k, (own, _) in enumerate(shards):
        suffix[weave == k] = own
    return suffix, block


def repeated(texts: list[bytes], group, place, ids, lo, n, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (id, first start, number) of the starts in these contexts whose strings start earlier in another of them."""
    place, ids, lo, n = (np.asarray(x, dtype=np.int64) for x in (place, ids, lo, n))
    strings = Strings(texts, place, np.asarray(group))
    dealt = [np.flatnonzero(strings.owner % shards == k) for k in range(min(shards, len(texts)))]
    suffix, block = merge([transform(strings, own) for own in dealt])
    real = strings.offset[suffix] < n[strings.owner[suffix]]
    suffix, block = suffix[real], block[real]
    owner = strings.owner[suffix]
    start = lo[owner] + strings.offset[suffix]
    order = np.lexsort((start, ids[owner], block))
    again = np.concatenate([[False], block[order][1:] == block[order][:-1]])
    hit = np.sort(suffix[order[again]])
    if not len(hit):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (strings.owner[hit[1:]] != strings.owner[hit[:-1]])]))
    number = np.diff(np.append(first, len(hit)))
    owner = strings.owner[hit[first]]
    return ids[owner], lo[owner] + strings.offset[hit[first]], number


RUNS = "id long, s int, n int"


def merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their minimisers; whole minimisers are merged in chunks."""
    held: list[list] = [[] for _ in range(6)]
    symbols, key = 0, None

    def done() -> pa.RecordBatch:
        _, ids, lo, n, place, texts = held
        seen: dict[bytes, int] = {}
        group = [seen.setdefault(t[p : p + GRAM], len(seen)) for t, p in zip(texts, place)]
        found = repeated(texts, group, place, ids, lo, n)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32))], names=["id", "s", "n"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[0] != key and symbols >= CHUNK_SYMBOLS:
                yield done()
                held, symbols = [[] for _ in range(6)], 0
            key = row[0]
            symbols += len(row[5]) - GRAM + 1
            for x, y in zip(held, row):
                x.append(y)
    if held[0]:
        yield done()


CUT = "h long, id long, lo int, n int, place int, bytes binary"


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for ident, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            for w in wanted:
                for x, y in zip(out, (w["h"], ident, w["lo"], w["n"], w["place"], text[w["lo"] : w["lo"] + w["n"] + LENGTH - 1])):
                    x.append(y)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["h", "id", "lo", "n", "place", "bytes"])


PART = "h long, c0 long, c1 long, id long, lo int, n int, place int, bytes binary"


def halved(width: int):
    """Splits contexts into those whose starts have the gram at one of ``width`` places, by place and by the bytes around the gram that all such strings have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, out = [], [[] for _ in range(5)]
            for _, ident, lo, n, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                for low in range(max(0, place - n + 1) // width * width, place + 1, width):
                    first, last = max(0, place - low - width + 1), min(n - 1, place - low)
                    around = data[place - low : place - low + LENGTH + 1 - width]
                    key.append(hashlib.sha256(around + bytes([low])).digest()[:8])
                    for x, y in zip(out, (ident, lo + first, last - first + 1, place - first, data[first : last + LENGTH])):
                        x.append(y)
            if key:
                names = np.frombuffer(b"".join(key), dtype=np.int64)
                c0, c1 = digests(out[4], np.array(out[3]))
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                columns = [pa.array(names), pa.array(c0.view(np.int64)), pa.array(c1.view(np.int64)), *(pa.array(x, t) for x, t in zip(out, types))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "c0", "c1", "id", "lo", "n", "place", "bytes"])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def applied(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, starts, numbers = batch.columns
            rows = []
            for text, s, n in zip(texts.to_pylist(), starts.to_pylist(), numbers.to_pylist()):
                if not s:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), *[text] * keep))
                    continue
                edge = np.zeros(len(text) + 1, dtype=np.int64)
                s = np.array(s)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + np.array(n) + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), *[left] * keep))
            columns = [pa.array(x) for x in zip(*rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 6 if keep else 5])

    return run


def identified(docs: DataFrame) -> DataFrame:
    """id (unique, in the order of doc_id), doc_id, text as bytes.

    Where doc_ids are unique they are the ids. Otherwise rows are numbered in
    the order of doc_id (null last) and text, and written with their numbers.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    bad = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if bad.isEmpty():
        return own.select(F.col("doc_id").alias("id"), "doc_id", "text")
    keyed = own.withColumn("k", F.coalesce("doc_id", F.lit(LAST))).withColumn("t", F.xxhash64("text"))
    sorted_ = keyed.repartitionByRange("k", "t").sortWithinPartitions("k", "t")
    return written(sorted_.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text"), "repeats-numbered")


CONTEXT = ("h", "id", "lo", "n", "place", "bytes")


def split_hot(cut: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts (h, id, lo, n, place, bytes) of which no minimiser, or part of one, has too many, and the runs that fell to folding."""
    runs, width = cut.where("false").select("id", F.col("lo").alias("s"), "n"), LENGTH - GRAM + 1
    ready = cut.join(hot, cut["h"] == hot["hot"], "left_anti")
    open_ = cut.join(hot, cut["h"] == hot["hot"], "left_semi")
    while not hot.isEmpty():
        width //= 2
        parts = written(open_.select(*CONTEXT).mapInArrow(halved(width), PART), "repeats-parts")
        same = ["h", "c0", "c1"]
        first = parts.groupBy(*same).agg(F.min(F.struct("id", "lo")).alias("first"))
        placed = written(parts.join(first, same), "repeats-folded")
        runs = runs.unionByName(placed.where(F.struct("id", "lo") != F.col("first")).select("id", F.col("lo").alias("s"), "n"))
        reps = placed.where(F.struct("id", "lo") == F.col("first")).select(*CONTEXT)
        several = written(reps.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), "repeats-several")
        # at one place the contexts of a part are equal, so nothing is left of it here
        hot = several.where(F.col("contexts") > MERGE_CONTEXTS).select(F.col("h").alias("hot"))
        usual = several.where(F.col("contexts") <= MERGE_CONTEXTS).select(F.col("h").alias("hot"))
        ready = ready.unionByName(reps.join(usual, reps["h"] == usual["hot"], "left_semi"))
        open_ = reps.join(hot, reps["h"] == hot["hot"], "left_semi")
    return ready, runs


def repeated_runs(texts: DataFrame) -> DataFrame:
    """Runs (id, s, n) of starts whose strings start earlier; ``texts`` has id and text as bytes."""
    found = texts.where(F.length("text") >= LENGTH).select("id", "text").mapInArrow(contexts, FOUND)
    same_gram = Window.partitionBy("h").orderBy("c0", "c1", "id", "lo")
    context = F.struct("c0", "c1")
    near = found.withColumns({"prior": F.lag(context).over(same_gram), "next": F.lead("c0").over(same_gram)})
    # how many different contexts a minimiser has is told where its rows are together anyway
    near = near.withColumn("first", ~F.col("prior").eqNullSafe(context))
    near = near.withColumn("contexts", F.sum(F.col("first").cast("int")).over(Window.partitionBy("h")))
    near = near.where("prior is not null or next is not null or size(more_id) > 0").drop("prior", "next", "c0", "c1")
    near = written(near, "repeats-contexts")
    whole = near.where("not first").select("id", "lo", "n").unionByName(
        near.where("size(more_id) > 0").select(F.inline(F.arrays_zip("more_id", "more_lo")), "n").select(F.col("more_id").alias("id"), F.col("more_lo").alias("lo"), "n")
    ).select("id", F.col("lo").alias("s"), "n")
    reps = near.where("first and contexts > 1").select("h", "id", "lo", "n", "place", "contexts")
    wanted = reps.groupBy("id").agg(F.collect_list(F.struct("h", "lo", "n", "place")).alias("wanted"))
    wanted = written(wanted, "repeats-wanted")
    if wanted.isEmpty():
        return whole
    cut = texts.select("id", "text").join(wanted.hint("shuffle_hash"), "id").mapInArrow(cut_out, CUT)
    hot = written(reps.where(F.col("contexts") > MERGE_CONTEXTS).select(F.col("h").alias("hot")).distinct(), "repeats-hot")
    if not hot.isEmpty():
        cut, folded = split_hot(written(cut, "repeats-cut"), hot)
        whole = whole.unionByName(folded)
    runs = cut.repartition("h").sortWithinPartitions("h").mapInArrow(merged_runs, RUNS)
    return written(runs, "repeats-runs").unionByName(whole)


def without_repeats(spark: SparkSession, docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` the bytes left.

    Strings do not cross documents, and are judged on the input. Null texts are
    empty; texts of under 100 bytes lose nothing, and those of any length are
    read whole. Repeated rows are documents of their own: those that share a
    doc_id follow each other in the order of their texts' hashes, and null doc_ids
    come last. An empty table gives an empty result; other columns are not
    looked at.
    """
    small_batches(docs.sparkSession)
    texts = identified(docs)
    runs = repeated_runs(texts).groupBy(F.col("id").alias("run_id")).agg(F.collect_list("s").alias("s"), F.collect_list("n").alias("n"))
    out = texts.join(runs.hint("shuffle_hash"), F.col("id") == F.col("run_id"), "left").select("doc_id", "text", "s", "n")
    return out.mapInArrow(applied(keep_text), RESULT + (", kept_text binary" if keep_text else ""))
