"""Vector operators: filtered nearest neighbours, candidates for duplicates, points."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import embed_text, point_id

DIMENSION = 384


def hashing_embedder(dimension: int = DIMENSION) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder without a model: signed hashes of words and letter trigrams, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dimension
            words = text.lower().split()
            for part in [*words, *(w[k : k + 3] for w in words for k in range(max(1, len(w) - 2)))]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def embedded(df: DataFrame, text: str = "text", make: Callable = hashing_embedder, dimension: int = DIMENSION) -> DataFrame:
    """Adds ``embedding``; blank texts are zero vectors. ``make`` builds the embedder once a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make(dimension)
        for texts in batches:
            texts = texts.fillna("")
            blank = texts.str.strip() == ""
            yield pd.Series([[0.0] * dimension if b else v for b, v in zip(blank, embed(texts.tolist()))])

    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def points(memories: DataFrame) -> DataFrame:
    """Point ids and the texts that memories are embedded by."""
    return memories.select("memory_id", point_id(F.col("memory_id")).alias("point_id"), embed_text(F.col("key"), F.col("value"), F.col("type")).alias("text"))


def put(points_: DataFrame, new: DataFrame) -> DataFrame:
    """Points with ``new`` ones in place of those with their ids; of several new ones the last (``at``) counts."""
    last = new.groupBy("point_id").agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("point_id", "at")]), "at").alias("r")).select("point_id", "r.*")
    return points_.join(last.select("point_id"), "point_id", "left_anti").unionByName(last, allowMissingColumns=True)


POINT = "point_id decimal(20,0), memory_id string, user_id long, memory_type string, vector array<float>"


def created(spark: SparkSession, path: str | None = None) -> DataFrame:
    """An empty collection; with a path, one on disk that is laid out by type, so a search of some types reads only these."""
    empty = spark.createDataFrame([], POINT)
    if path is None:
        return empty
    empty.write.mode("overwrite").partitionBy("memory_type").parquet(path)
    return spark.read.schema(POINT).parquet(path)


def saved(points_: DataFrame, path: str, dimension: int = DIMENSION) -> DataFrame:
    """Adds points to a collection on disk; vectors of another dimension are an error."""
    checked(points_, dimension).write.mode("append").partitionBy("memory_type").parquet(path)
    return points_.sparkSession.read.schema(POINT).parquet(path)


def recreated(points_: DataFrame, path: str | None = None) -> DataFrame:
    """The collection dropped and made anew: empty, for all users."""
    return created(points_.sparkSession, path)


def checked(points_: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """Points whose vectors have the dimension of the collection; reading others fails."""
    wrong = F.concat(F.lit(f"a vector of a collection of {dimension} has "), F.size("vector").cast("string"))
    sound = F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(wrong).cast(points_.schema["vector"].dataType))
    return points_.withColumn("vector", sound)


def indexed(memories: DataFrame, make: Callable = hashing_embedder, dimension: int = DIMENSION) -> DataFrame:
    """The points of memories: their ids, what a search filters by, and the vectors of their texts."""
    text = embed_text(F.col("key"), F.col("value"), F.col("type"))
    rows = embedded(memories.withColumn("__text", text), "__text", make, dimension)
    return rows.select(point_id(F.col("memory_id")).alias("point_id"), "memory_id", "user_id", F.col("type").alias("memory_type"), F.col("embedding").alias("vector"))


def removed(points_: DataFrame, ids: DataFrame) -> DataFrame:
    """Points without those of the memories ``ids`` (memory_id)."""
    gone = ids.select(point_id(F.col("memory_id")).alias("point_id")).distinct()
    return points_.join(gone, "point_id", "left_anti")


def counted(points_: DataFrame) -> DataFrame:
    """n: the points of all users."""
    return points_.agg(F.count(F.lit(1)).alias("n"))


#: Vectors that one task multiplies with as many others.
BLOCK = 1024


def blocks(rows: DataFrame, on: list[str], name: str, size: int = BLOCK) -> DataFrame:
    """``rows`` (id, vector, and ``on``) in blocks of about ``size``: on, name, name_n (blocks of that group), and arrays of ids and vectors."""
    sizes = rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{name}_n"))
    dealt = rows.join(sizes, on).withColumn(name, F.pmod(F.xxhash64("id"), F.col(f"{name}_n")).cast("int"))
    both = F.collect_list(F.struct("id", F.col("vector").cast("array<double>").alias("v")))
    return dealt.groupBy(*on, name, f"{name}_n").agg(both.alias(f"{name}_rows"))


#: What a score of a matrix product may be off by; within it of a bound, a pair's own cosine decides.
SLACK = 1e-9
#: Pairs whose cosines are taken at once.
PAIRS = 32768


def summed(products: np.ndarray) -> np.ndarray:
    """Sums over the first axis, in its order."""
    return sum(products, np.zeros(products.shape[1]))


def columns(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors (a row a dimension) and their lengths, 1 for a zero vector."""
    ids = np.array([r["id"] for r in rows])
    vectors = np.array([r["v"] for r in rows], dtype=np.float64).T.copy()
    norm = np.sqrt(summed(vectors * vectors))
    return ids, vectors, np.where(norm == 0, 1.0, norm)


def cosines(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs i, j (in the order of i), each summed in the order of the dimensions, as SQL does it.

    The last bits of a matrix product depend on where a row stands in its
    block. These do not: equal vectors have equal scores, and ties stay ties.
    Where many pairs are asked for, whole rows are summed, in the same order.
    """
    out = np.empty(len(i))
    if 8 * len(i) > len(nu) * len(nv):
        step = max(1, PAIRS // len(nv))
        for k in range(0, len(nu), step):
            total = np.zeros((len(nu[k : k + step]), len(nv)))
            for x, y in zip(u[:, k : k + step], v):
                total += x[:, None] * y
            own = slice(*np.searchsorted(i, [k, k + step]))
            out[own] = total[i[own] - k, j[own]]
    else:
        for k in range(0, len(i), PAIRS):
            own = slice(k, k + PAIRS)
            out[own] = summed(u[:, i[own]] * v[:, j[own]])
    return out / (nu[i] * nv[j])


def scored(pairs: DataFrame, least: float, limit: int | None, a_kind: str, b_kind: str) -> DataFrame:
    """a, b, score of block pairs (a_rows, b_rows): a matrix product a pair of blocks, of which what is below ``least`` goes at once; the rest by its own cosine."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x, y in zip(frame["a_rows"], frame["b_rows"]):
                (a, u, nu), (b, v, nv) = columns(x), columns(y)
                near = (u / nu).T @ (v / nv)
                keep = near >= least - SLACK
                if limit is not None and len(b) > limit:
                    # ties at the edge stay, so the ranking that follows decides them
                    edge = np.partition(np.where(keep, near, -np.inf), -limit, axis=1)[:, -limit]
                    keep &= near >= edge[:, None] - SLACK
                i, j = np.nonzero(keep)
                score = cosines(u, v, nu, nv, i, j)
                i, j, score = i[score >= least], j[score >= least], score[score >= least]
                if len(i):
                    yield pd.DataFrame({"a": a[i], "b": b[j], "score": score})

    return pairs.select("a_rows", "b_rows").mapInPandas(run, f"a {a_kind}, b {b_kind}, score double")


def nearest(queries: DataFrame, rows: DataFrame, on: list[str], limit: int, least: float, types: tuple[str, ...] | None = None, tie: str = "id") -> DataFrame:
    """For each query (query_id, vector, and ``on``) its nearest rows (id, vector, and ``on``): query_id, id, score, rank.

    ``on`` are columns that must be equal, ``types`` the types (memory_type)
    that count; both are filters before any product. Queries and rows meet in
    blocks, each pair of blocks in one matrix product; what is below ``least``
    or not among a block's best goes there. Null vectors match nothing.
    """
    kept = rows.where("vector is not null").withColumn("__all", F.lit(0))
    if types is not None:
        kept = kept.where(F.col("memory_type").isin(*types))
    on = [*on, "__all"]
    a = blocks(queries.where("vector is not null").withColumn("__all", F.lit(0)).select(*on, F.col("query_id").alias("id"), "vector"), on, "a")
    b = blocks(kept.select(*on, "id", "vector"), on, "b")
    pairs = spread(a, b, on)
    found = scored(pairs, least, limit, queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString())
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie)
    found = found.select(F.col("a").alias("query_id"), F.col("b").alias("id"), "score")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def spread(a: DataFrame, b: DataFrame, on: list[str], half: bool = False) -> DataFrame:
    """Pairs of blocks of one group: each of ``a`` with all of ``b``, or with ``half`` a table's blocks with themselves and the later ones."""
    if half:
        left = a.withColumn("b", F.explode(F.sequence("a", F.col("a_n") - 1)))
    else:
        known = a.join(b.groupBy(*on).agg(F.max("b_n").alias("b_n")), on)
        left = known.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("b_n") - 1))).drop("b_n")
    return left.join(b.drop("b_n"), [*on, "b"])


def similar_pairs(rows: DataFrame, on: list[str], least: float) -> DataFrame:
    """id, other_id, score of all pairs of rows (id, vector, and ``on``) of one group that are at least so near; other_id is the smaller."""
    on = [*on, "__all"]
    kept = rows.where("vector is not null").withColumn("__all", F.lit(0)).select(*on, "id", "vector")
    a = blocks(kept, on, "a")
    b = a.select(*on, F.col("a").alias("b"), F.col("a_n").alias("b_n"), F.col("a_rows").alias("b_rows"))
    kind = rows.schema["id"].dataType.simpleString()
    found = scored(spread(a, b, on, half=True), least, None, kind, kind)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return found.where("a != b").groupBy(high.alias("id"), low.alias("other_id")).agg(F.max("score").alias("score"))


def duplicate_candidates(rows: DataFrame, on: list[str], least: float, limit: int = 5) -> DataFrame:
    """For each row (id, vector, and ``on``) up to ``limit`` earlier rows that are at least so near: on, id, other_id, score, rank."""
    pairs = similar_pairs(rows, on, least).join(rows.select("id", *on), "id")
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), "other_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(*on, "id", "other_id", "score", "rank")


def searched(queries: DataFrame, points_: DataFrame, limit: int = 10, types: tuple[str, ...] | None = None, least: float = 0.0, by_user: bool = True, make: Callable = hashing_embedder, dimension: int = DIMENSION) -> DataFrame:
    """Search by text: queries (query_id, text, user_id) are embedded as they are, and their nearest points follow: query_id, memory_id, score, rank."""
    asked = embedded(queries, "text", make, dimension).withColumnRenamed("embedding", "vector")
    rows = checked(points_, dimension).withColumnRenamed("memory_id", "id")
    found = nearest(asked, rows, ["user_id"] if by_user else [], limit, least, types)
    return found.withColumnRenamed("id", "memory_id")
