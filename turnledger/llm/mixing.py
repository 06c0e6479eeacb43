"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes in words are summed by source, and targets follow from the weights:
   a source's target stops at ``max_repeats`` times its size, and the excess
   goes to the others by weight until none is above.
2. A hash deals the documents of a source into blocks, about as many as the
   root of the number of its documents, so that neither the blocks of a source
   nor the documents of a block are many, whichever source holds most rows.
   Whole epochs take every block; the partial epoch takes permuted blocks that
   fit the words left, and at last single documents of one more block.
3. The exact block quotas of all sources are split among the output shards by a
   binary tree: at each node a multivariate-hypergeometric draw tells how many
   blocks of each source go left. The leaves add up to the quotas exactly.
4. The leaves make the draws: a shard takes as many places of a source's permuted
   blocks as its leaf says, next to those of the shard before, so draws are
   disjoint. What no leaf takes is not drawn. Rows are shuffled in their shard
   by a hash.

Texts are never moved here: all steps work on identifiers and sizes. The tree
works on one number a source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SHARDS = 16
SEED = 20240501
MIN_BLOCKS = 1024
#: Words in a partition of the written mix, about 30 MB of text.
PART_WORDS = 5_000_000


def n_words(column: str = "text") -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(column), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sid, source, source_size, n_docs, target from one row a source (source, source_size, n_docs).

    Sources in the order of their code points, null last, have the weights in
    turn. With the sources in the order of the weight at which they reach their
    limit, the reshared weights end where the first source stays below it, so
    one pass of running sums finds what repeated resharing would.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sid = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("sid", sid).withColumn("weight", weight)
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("whole") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    rows = rows.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return rows.select("sid", "source", "source_size", "n_docs", target.alias("target"))


def swapped(words: np.ndarray, chosen: np.ndarray, left: int, most: int = 16) -> tuple[np.ndarray, int]:
    """Exchanges a chosen block for a larger one that still fits, while that uses up more of the words left."""
    chosen = chosen.copy()
    for _ in range(most):
        own, others = np.flatnonzero(chosen), np.flatnonzero(~chosen)
        if left <= 0 or not len(own) or not len(others):
            break
        others = others[words[others].argsort(kind="stable")]
        at = np.searchsorted(words[others], words[own] + left, side="right") - 1
        gain = np.where(at >= 0, words[others[at]] - words[own], 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        chosen[own[best]], chosen[others[at[best]]] = False, True
        left -= int(gain[best])
    return chosen, left


def take_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source that make up its quota, in permuted order: epoch, block, words still wanted of it (-1: all)."""
    blocks = blocks.sort_values(["place", "block"], kind="stable")
    size, target = int(blocks["words"].sum()), float(blocks["target"].iloc[0])
    draws, left, epoch = [], round(target), 0
    while size and left >= size:
        draws += [(epoch, b, -1) for b in blocks["block"]]
        left, epoch = left - size, epoch + 1
    words = blocks["words"].to_numpy()
    chosen = np.zeros(len(blocks), dtype=bool)
    for k, n in enumerate(words if left > 0 else ()):
        if n <= left:
            chosen[k], left = True, left - n
    chosen, left = swapped(words, chosen, left)
    names = blocks["block"].to_numpy()
    draws += [(epoch, b, -1) for b in names[chosen]]
    if left > 0 and not chosen.all():
        others = np.flatnonzero(~chosen)
        draws.append((epoch, names[others[words[others].argmin()]], left))
    out = pd.DataFrame(draws, columns=["epoch", "block", "wanted"])
    out.insert(0, "sid", int(blocks["sid"].iloc[0]))
    return out


def take_docs(docs: pd.DataFrame) -> pd.DataFrame:
    """The documents of one block, in permuted order, that fit the words wanted; one more where that comes nearer."""
    docs = docs.sort_values(["place", "doc_id", "row_id"], kind="stable")
    left, taken = int(docs["wanted"].iloc[0]), np.zeros(len(docs), dtype=bool)
    sizes = docs["size"].to_numpy()
    for k, size in enumerate(sizes):
        if size <= left:
            taken[k], left = True, left - size
    others = np.flatnonzero(~taken)
    if len(others) and sizes[(k := others[sizes[others].argmin()])] < 2 * left:
        taken[k] = True
    return docs.loc[taken, ["row_id", "epoch"]]


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each shard (rows) and source: the leaves of the splitting tree."""

    def node(colours: np.ndarray, first: int, last: int, path: tuple[int, ...]) -> Iterator[np.ndarray]:
        if last - first == 1:
            yield colours
            return
        middle = (first + last) // 2
        number = int(colours.sum()) * (middle - first) // (last - first)
        draw = np.random.default_rng([seed, *path]).multivariate_hypergeometric(colours, number, method="marginals")
        yield from node(draw, first, middle, (*path, 0))
        yield from node(colours - draw, middle, last, (*path, 1))

    return np.array(list(node(quotas.astype(np.int64), 0, shards, (1,))))


def mix(
    spark: SparkSession, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
    shards: int = SHARDS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(rows, draws). rows: row_id, doc_id, size, source_size, target. draws: row_id, epoch, shard, order_key.

    A row of ``draws`` is one use of a document, which is taken whole, so a
    source comes as near its target as its documents allow; a document has up to
    ``max_repeats`` of them, each in an epoch of its own. A null or empty text
    has size 0 and is drawn with its block. A null source is a source of its
    own, the last. Ties of hashes go by doc_id; repeated rows are documents of
    their own. Runs agree, as everything hangs on doc_id and ``seed``.
    """
    own = written(docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), n_words().alias("size"),
    ), "mix-sizes")
    sizes = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    wanted = written(targets(sizes, weights, share, max_repeats), "mix-targets")
    n_blocks = F.greatest(F.lit(MIN_BLOCKS), F.sqrt("n_docs").cast("long"))
    other = wanted.withColumnRenamed("source", "source_")
    rows = own.join(other, F.col("source").eqNullSafe(F.col("source_"))).select(
        "row_id", "doc_id", "sid", "size", "source_size", "target",
        F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), n_blocks).alias("block"),
    )
    rows = written(rows, "mix-rows")
    place = lambda *by: F.xxhash64(F.lit(seed), *by)
    blocks = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    blocks = blocks.withColumn("place", place(F.lit("block"), "sid", "block"))
    draws = blocks.groupBy("sid").applyInPandas(take_blocks, "sid int, epoch int, block long, wanted long")
    in_source = Window.partitionBy("sid").orderBy(place(F.lit("draw"), "sid", "epoch", "block"), "epoch", "block")
    permuted = written(draws.withColumn("rank", F.row_number().over(in_source) - 1), "mix-permuted")

    def tree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotas = pd.concat([pd.DataFrame({"sid": [], "n": []}), *batches]).sort_values("sid")
        if len(quotas):
            last = split_tree(quotas["n"].to_numpy(), shards, seed).cumsum(axis=0)
            first = np.vstack([np.zeros_like(last[:1]), last[:-1]])
            shard, source = np.nonzero(last > first)
            sid = quotas["sid"].to_numpy().astype(int)[source]
            yield pd.DataFrame({"sid": sid, "shard": shard, "first": first[shard, source], "last": last[shard, source]})

    # one number a source goes through the tree, whatever the number of rows
    quotas = permuted.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).coalesce(1)
    leaves = quotas.mapInPandas(tree, "sid int, shard int, first long, last long")
    places = leaves.select("sid", "shard", F.explode(F.sequence("first", F.col("last") - 1)).alias("rank"))
    dealt = permuted.join(places, ["sid", "rank"]).drop("rank")
    uses = rows.select("row_id", "doc_id", "sid", "size", "block").join(dealt, ["sid", "block"])
    parted = uses.where("wanted >= 0").withColumn("place", place(F.lit("doc"), "doc_id"))
    parted = parted.groupBy("sid", "block").applyInPandas(take_docs, "row_id long, epoch int")
    uses = uses.where("wanted < 0").unionByName(uses.where("wanted >= 0").join(parted, ["row_id", "epoch"], "left_semi"))
    uses = uses.select("row_id", "epoch", "shard", place(F.lit("order"), "doc_id", "epoch").alias("order_key"))
    return rows.drop("sid", "block"), uses


def taken_words(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, shards (of its uses).

    Null, empty and repeated rows are as in ``mix``. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows, uses = mix(spark, docs, **options)
    used = uses.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("shard")).alias("shards"))
    none = F.array().cast("array<int>")
    return rows.join(used, "row_id", "left").select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.coalesce("n", F.lit(0))).alias("taken"), F.coalesce("shards", none).alias("shards"),
    )


def mixed(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, part_words: int = PART_WORDS, **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are drawn, dealt by shard, shuffled in each.

    Uses are brought to documents by doc_id, so a table that repeats doc_ids
    has its repeated rows taken as one document. A shard of more than about
    ``part_words`` words is written in several parts, each a partition of its own
    number, so partitions keep their size however large the mix is and none
    has two parts. Null, empty and repeated rows are as in ``mix``; an empty
    table gives an empty result; columns of any name pass.
    """
    columns = docs.columns
    rows, uses = mix(spark, docs, shards=shards, **options)
    total = rows.agg(F.sum("size")).first()[0] or 0
    slices = max(1, math.ceil(total * SHARE / part_words / shards))
    drawn = rows.select("row_id", "doc_id").join(uses, "row_id")
    drawn = drawn.groupBy("doc_id", "epoch").agg(F.min(F.struct("shard", "order_key")).alias("use"))
    drawn = drawn.select(F.col("doc_id").alias("use_id"), "use")
    own = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), docs["doc_id"].cast("long").alias("use_id_"))
    out = own.join(drawn, F.col("use_id_").eqNullSafe(F.col("use_id"))).select("row", "use.shard", "use.order_key")
    part = (F.col("shard") * slices + F.pmod(F.col("order_key"), F.lit(slices))).cast("int")
    return out.withColumn("part", part).repartitionById(shards * slices, "part").sortWithinPartitions("order_key").select("row.*")
