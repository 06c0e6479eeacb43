"""Near-duplicates by circulant MinHash, banding, and exact Jaccard similarity.

1. Every text becomes its set of word shingles, as 64-bit numbers made of keyed
   hashes of the words. Texts with the same set form a class, found by a digest
   of the set (of the words themselves where a set is small), and go on as one row.
2. Two permutations of a universe of 2^32 give all coordinates of a signature:
   the first is applied once, the second to the result shifted circularly by
   the number of the coordinate. Bands of coordinates are hashed to buckets.
   There are as many bands of 6 rows as a threshold needs, so that a pair at it
   shares no bucket with a probability of at most 1e-6: 30 at 0.85, 46 at 0.80.
3. Classes of a bucket are tied to its smallest class, not to each other; the
   components of these ties are the groups in which links can lie.
4. Groups are cut into chunks of bounded size, each with the group's smallest
   class. A chunk has the words of its texts. They are numbered, and shingles are
   numbered by their words, so no hash takes part; a matrix product gives the
   exact sizes of all intersections. Links are taken to components there, so
   what leaves a chunk is at most a row a class. Groups of one chunk are done
   with that. In larger ones the classes that did not come to the first one's
   component go on: those whose buckets are all small are compared within their
   buckets, so the work of a group that hangs together by chance is that of its
   buckets; those with a bucket of more than a chunk are compared with every
   other chunk of their group. What a hot group has linked is not compared again.
5. The components of all links follow in DataFrames.

Links are confirmed on the full sets of words. Nothing of it is collected to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .components import components

SHINGLE = 5
#: Similarity from which documents are linked, in per cent, where no other is given.
PERCENT = 85
ROWS = 6
#: Probability that a pair at the threshold shares no bucket, at most.
MISSED = 1e-6
#: Text that one step holds; classes and words of a chunk.
STEP_BYTES = 1 << 20
CHUNK_CLASSES, CHUNK_WORDS = 1024, 2_000_000
COLUMNS = 4096
#: Sets of up to so many shingles are told apart by their words. In larger ones two collisions of 64-bit hashes would have
#: to meet, as sets that differ in one shingle alone are near-duplicates anyway.
SMALL = 32

_RANDOM = np.random.default_rng(9)
_PLACES = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def mixed64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mixed32(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A keyed 64-bit hash of each word's bytes; each different word is hashed once."""
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.util.hash_array(held) if len(words) else np.zeros(0, dtype=np.uint64)


def words_of(text: bytes) -> list[bytes]:
    """The words between ASCII white space, A-Z lowered."""
    return text.lower().split()


def shingled(texts: list[list[bytes]], width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text's words; a text of fewer words has its whole sequence as one."""
    word = word_hashes([w for words in texts for w in words])
    n = max(0, len(word) - width + 1)
    summed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        summed += word[k : k + n] * _PLACES[k]
    summed = mixed64(summed)
    out, a = [], 0
    for words in texts:
        b = a + len(words)
        if b - a >= width:
            out.append(np.unique(summed[a : b - width + 1]))
        elif b > a:
            out.append(mixed64((word[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACES[8 + b - a]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        a = b
    return out


def identity(words: list[bytes], shingles: np.ndarray, width: int = SHINGLE) -> bytes:
    """A digest by which equal sets are known."""
    if len(shingles) > SMALL:
        return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    windows = {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    return hashlib.blake2b(b"\n".join(sorted(windows)), digest_size=16).digest()


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows with which pairs at ``percent`` similarity are missed with a probability of at most MISSED."""
    same = (percent / 100) ** rows
    return 1 if same >= 1 else math.ceil(math.log(MISSED) / math.log1p(-same))


def signatures(sets: list[np.ndarray], coordinates: int = bands_for(PERCENT) * ROWS) -> np.ndarray:
    """Circulant MinHash of sets that are not empty: one row of 32-bit coordinates a set."""
    every = np.concatenate(sets)
    first = mixed32((every ^ (every >> np.uint64(32))).astype(np.uint32))
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    start = np.cumsum(size) - size
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(mixed32(first + np.uint32(k)), start)
    return out


def buckets(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    cut = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    band = mixed64(np.arange(1, cut.shape[1] + 1, dtype=np.uint64))
    return mixed64((cut * _PLACES[:rows]).sum(axis=2, dtype=np.uint64) + band).astype(np.int64)


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


SIGNED = "row_id long, doc_id long, n_shingles long, digest binary, buckets array<long>"


def signed(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in steps(texts):
            words = [words_of(t) for t in texts[a:b]]
            sets = shingled(words)
            full = [s for s in sets if len(s)]
            keys = iter(buckets(signatures(full, bands * ROWS)) if full else ())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([identity(w, s) for w, s in zip(words, sets)], pa.binary()),
                pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ], names=["row_id", "doc_id", "n_shingles", "digest", "buckets"])


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowered words of each text, a digest of them, and their number."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in steps(texts):
            words = [words_of(t) for t in texts[a:b]]
            joined = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array([len(w) for w in words], pa.int64()),
                pa.array([hashlib.sha256(j).digest() for j in joined], pa.binary()), pa.array(joined, pa.binary()),
            ], names=["class", "n", "sha", "words"])


def numbered(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers: equal numbers, and only they, are equal words in equal order."""
    words = [t.split() for t in texts]
    held = np.empty(sum(map(len, words)), dtype=object)
    held[:] = [w for own in words for w in own]
    word = pd.factorize(held)[0].astype(np.int64)
    base, run = np.int64(len(word) + 1), word
    for k in range(1, width):
        n = max(0, len(word) - k)
        run = np.unique(run[:n] * base + word[k : k + n], return_inverse=True)[1]
    out, short, a = [], {}, 0
    for own in words:
        b = a + len(own)
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            out.append(np.array([-1 - short.setdefault(tuple(own), len(short))]))
        else:
            out.append(np.zeros(0, dtype=np.int64))
        a = b
    return out


def tied(sets: list[np.ndarray], percent: int, names: np.ndarray | None = None) -> np.ndarray:
    """For each set the first set of its component, over links of at least ``percent`` similarity, and of equal names.

    The sizes of all intersections come from products of 0/1 matrices over the
    elements that two sets share at all, a slice of them at a time.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, dtype=np.int64)
        common[1] = common[0][::-1]
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        place = np.cumsum(shared) - 1
        row = np.repeat(np.arange(n), size)
        use = shared[column]
        row, column = row[use], place[column[use]]
        order = column.argsort(kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((n, n), dtype=np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            block = np.zeros((n, COLUMNS), dtype=np.float32)
            block[row[a:b], column[a:b] - low] = 1
            common += block @ block.T
        common = common.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    link = 100 * common >= percent * union
    np.fill_diagonal(link, True)
    if names is not None and len(np.unique(names)) < n:
        link |= names[:, None] == names[None, :]
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS = "a long, b long"


def links_of_chunks(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Edges from each class to the first class of its component in the chunk; chunks come one after the other."""
    held, key = [], None

    def done() -> Iterator[pd.DataFrame]:
        pdf = pd.concat(held).drop_duplicates(["class", "sha"]).sort_values(["class", "sha"])
        if len(pdf) > 1:
            names = pdf["class"].to_numpy()
            first = names[tied(numbered(pdf["words"].tolist()), percent, names)]
            away = first != names
            if away.any():
                yield pd.DataFrame({"a": names[away], "b": first[away]})

    for frame in frames:
        keys = list(zip(frame["grp"], frame["p"], frame["q"]))
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != key:
                yield from done()
                held = []
            key = keys[a]
            held.append(frame.iloc[a:b])
    if held:
        yield from done()


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Edges within the chunks (grp, p, q) of ``rows`` (class, sha, words)."""
    dealt = rows.select("grp", "p", "q", "class", "sha", "words").repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q")
    return written(dealt.mapInPandas(partial(links_of_chunks, percent=percent), LINKS), "near-links")


def links(texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components are those of all links between classes.

    ``texts`` has doc_id and the text as bytes; ``classes`` has class (a
    doc_id) and buckets.
    """
    spread = classes.select("class", F.explode("buckets").alias("bucket"))
    spread = written(spread, "near-buckets")
    many = spread.groupBy("bucket").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ties = spread.join(many, "bucket").where(F.col("class") != F.col("first")).select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    group = components(ties).withColumnRenamed("node", "class").withColumnRenamed("label", "grp")
    group = written(group, "near-candidates")
    # how the candidates' identifiers come to the texts is Spark's choice, by the size of the written table
    own = texts.join(group.select("class"), F.col("doc_id") == F.col("class"), "left_semi").mapInArrow(tokenised, "class long, n long, sha binary, words binary")
    # a doc_id that stands in several rows counts with each of its texts
    own = own.groupBy("class", "sha").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    own = written(own.join(group, "class"), "near-sets")
    stats = own.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK_CLASSES), F.ceil(F.col("total") / CHUNK_WORDS)).cast("int")
    large = written(stats.select("grp", chunks.alias("chunks")).where("chunks > 1"), "near-large")
    sized = own.join(large, "grp", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    sized = sized.withColumn("p", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")).withColumn("q", F.lit(-1))
    heads = sized.where((F.col("chunks") > 1) & (F.col("class") == F.col("grp")))
    heads = heads.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = compared(sized.unionByName(heads), percent)
    if large.isEmpty():
        return found
    # what has not come to the component of the group's first class goes on
    part = components(found)
    large_rows = sized.where("chunks > 1").join(part, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class")).drop("node")
    large_rows = written(large_rows, "near-large-rows")
    rest = written(large_rows.where(F.col("label") != F.col("grp")).select("grp", "class").distinct(), "near-rest")
    if rest.isEmpty():
        return found
    # where its buckets are small it meets those of its buckets, whichever the group; sets of classes that several buckets share once
    held = spread.join(large_rows.groupBy("class").agg(F.max("n").alias("n")), "class")
    big = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where((F.col("size") > CHUNK_CLASSES) | (F.col("total") > CHUNK_WORDS))
    wide = spread.join(big.where("size > 1").select("bucket"), "bucket").join(rest, "class").select("class").distinct()
    wide = written(wide, "near-wide")
    narrow = spread.join(rest.join(wide, "class", "left_anti").select("class"), "class", "left_semi").select("bucket").distinct()
    sets = spread.join(narrow, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_set("class")).alias("classes")).where("size(classes) > 1")
    sets = sets.groupBy("classes").agg(F.min("bucket").alias("grp")).select("grp", F.explode("classes").alias("class"))
    sets = sets.join(own.select("class", "sha", "words"), "class").withColumn("p", F.lit(0)).withColumn("q", F.lit(-2))
    found = found.unionByName(compared(sets, percent))
    # where one is wide it meets all chunks of its group
    rest = large_rows.join(wide, "class", "left_semi")
    count = rest.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_CLASSES), F.ceil(F.sum("n") / CHUNK_WORDS)).cast("int").alias("parts"))
    rest = rest.join(count, "grp").withColumn("q", F.pmod(F.xxhash64(F.lit(1), "class"), F.col("parts")).cast("int"))
    rest = rest.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("parts")
    others = large_rows.join(count, "grp").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return found.unionByName(compared(others.unionByName(rest), percent))


def near_groups(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z are lowered, words are what ASCII white space leaves; documents whose
    sets have a similarity of at least ``percent`` % are linked. component_id is the
    smallest doc_id that links reach. A null or empty text, or one without
    words, has no shingles and is linked with nothing. Rows that share a doc_id
    are one document, with the links of all its texts. A row without doc_id is linked with nothing, has a null
    component_id, and is kept. An empty table gives an empty result; other
    columns are not looked at.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(partial(signed, bands=bands_for(percent)), SIGNED)
    rows = written(rows, "near-signed")
    able = rows.where("n_shingles > 0 and doc_id is not null")
    classes = able.groupBy("digest").agg(F.min("doc_id").alias("class"), F.first("buckets").alias("buckets"))
    classes = written(classes, "near-classes")
    copies = able.join(classes.select("digest", "class"), "digest").where(F.col("doc_id") != F.col("class"))
    edges = links(texts, classes.select("class", "buckets"), percent)
    edges = edges.select("a", "b").unionByName(copies.select(F.col("class").alias("a"), F.col("doc_id").alias("b")))
    label = components(edges)
    out = rows.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns.

    What links documents, and what null, empty and repeated rows are, is as in
    ``near_groups``: rows without a doc_id stay, and so do all rows of a doc_id
    that stays. An empty table gives an empty result.
    """
    kept = near_groups(spark, docs, percent).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
