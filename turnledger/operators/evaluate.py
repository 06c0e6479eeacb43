"""Evaluation: how well extraction, retrieval and consolidation do against a truth."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def same(found: str = "f", truth: str = "t") -> Column:
    """Same type, and one value or one key that is not empty holds the other."""
    keys = (F.col(f"{found}.key") != "") & (F.col(f"{truth}.key") != "") & contains_either(F.col(f"{found}.key"), F.col(f"{truth}.key"))
    return (F.col(f"{found}.type") == F.col(f"{truth}.type")) & (contains_either(F.col(f"{found}.value"), F.col(f"{truth}.value")) | keys)


def matches(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs of structs f and t that match, in their scope; an equi-join on scope and type."""
    f = found.select("user_id", "type", F.struct(*found.columns).alias("f"))
    t = truth.select("user_id", "type", F.struct(*truth.columns).alias("t"))
    return f.join(t, ["user_id", "type"]).where(same())


def content(name: str) -> Column:
    """Key and value of a struct as one lower-cased text."""
    return F.lower(F.concat(F.coalesce(F.col(f"{name}.key"), F.lit("")), F.lit(" "), F.coalesce(F.col(f"{name}.value"), F.lit(""))))


def alike(found: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, memory_id, rank, id: found rows and truths of one type of which one's key and value, as one text, holds the other's.

    This is how retrieval is judged; extraction is judged by ``same``.
    """
    f = found.select("user_id", "type", "memory_id", "rank", F.struct("key", "value").alias("f"))
    t = truth.select("user_id", "type", "id", F.struct("key", "value").alias("t"))
    a, b = content("f"), content("t")
    return f.join(t, ["user_id", "type"]).where(F.contains(a, b) | F.contains(b, a)).select("user_id", "memory_id", "rank", "id")


def users_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, n_found, n_truth of every scope that has either."""
    rows = found.select("user_id", F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(truth.select("user_id", F.lit(0).alias("f"), F.lit(1).alias("t")))
    return rows.groupBy("user_id").agg(F.sum("f").alias("n_found"), F.sum("t").alias("n_truth"))


def context_precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, n_found, n_matched, precision: the share of found rows that are like a truth, 0 where nothing was found."""
    hit = alike(found, truth).groupBy("user_id").agg(F.count_distinct("memory_id").alias("n_matched"))
    rows = users_of(found, truth).join(hit, "user_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return rows.select("user_id", "n_found", "n_matched", F.when(F.col("n_found") == 0, 0.0).otherwise(F.col("n_matched") / F.col("n_found")).alias("precision"))


def context_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, n_truth, n_matched, recall: the share of truths (id) that a found row is like, 1 where there is no truth."""
    hit = alike(found, truth).groupBy("user_id").agg(F.count_distinct("id").alias("n_matched"))
    rows = users_of(found, truth).join(hit, "user_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return rows.select("user_id", "n_truth", "n_matched", F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("n_matched") / F.col("n_truth")).alias("recall"))


def ranking_quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, mrr, avg_position, top_1, top_3, top_5, top_10; found rows carry rank.

    mrr is 1 over the place of the first found row that is like any truth;
    avg_position the mean over truths of the first row like them, of those that
    have one; top_k the share of truths with such a row within k places. All are
    0 where nothing matches, and the shares null where nothing was found or
    there is no truth.
    """
    first = alike(found, truth).groupBy("user_id", "id").agg(F.min("rank").alias("place"))
    within = [F.sum((F.col("place") <= k).cast("long")).alias(f"k{k}") for k in (1, 3, 5, 10)]
    by = first.groupBy("user_id").agg(F.min("place").alias("best"), F.avg("place").alias("average"), *within)
    rows = users_of(found, truth).join(by, "user_id", "left")
    both = (F.col("n_found") > 0) & (F.col("n_truth") > 0)
    top = [F.when(both, F.coalesce(f"k{k}", F.lit(0)) / F.col("n_truth")).alias(f"top_{k}") for k in (1, 3, 5, 10)]
    return rows.select("user_id", F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("mrr"), F.coalesce("average", F.lit(0.0)).alias("avg_position"), *top)


def distance_recall(found: DataFrame, truth: DataFrame, distances: tuple[int, ...], band: int = 2) -> DataFrame:
    """user_id, distance, expected, found, recall: truths whose turn is within ``band`` of now - distance, and those a found row is like.

    Distances without a truth have no row.
    """
    at = F.explode(F.filter(F.array(*map(F.lit, distances)), lambda d: F.abs(F.col("turn_number") - (F.col("now") - d)) <= band))
    hit = alike(found, truth).select("user_id", "id").distinct().withColumn("hit", F.lit(1))
    rows = truth.withColumn("distance", at).join(hit, ["user_id", "id"], "left")
    rows = rows.groupBy("user_id", "distance").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("found"))
    return rows.withColumn("recall", F.col("found") / F.col("expected"))


def decay_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """deleted, decayed, and the average loss of the decayed, by memory_id."""
    rows = before.select("memory_id", F.col("confidence").alias("b")).join(after.select("memory_id", F.col("confidence").alias("a")), "memory_id", "left")
    lost = F.when(F.col("a") < F.col("b"), F.col("b") - F.col("a"))
    return rows.agg(F.count(F.when(F.col("a").isNull(), 1)).alias("deleted"), F.count(lost).alias("decayed"), F.avg(lost).alias("average_loss"))


def duplicates(memories: DataFrame) -> DataFrame:
    """Rows that share a signature (type, first 20 characters of the key) with another, by scope."""
    by = memories.groupBy("user_id", "type", F.left(F.lower("key"), F.lit(20)).alias("sign")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("user_id").agg((F.sum("n") - F.count(F.lit(1))).alias("duplicates"), F.sum("n").alias("n"))


def merging(before: DataFrame, after: DataFrame) -> DataFrame:
    """user_id, total_before, total_after, reduction, merged, duplicates_remaining: what a run of merges did to active rows."""
    b = before.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_before"))
    a = after.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_after"), F.count(F.when(F.col("memory_id").startswith("merged_"), 1)).alias("merged"))
    rows = b.join(a, "user_id", "left").join(duplicates(after).select("user_id", F.col("duplicates").alias("duplicates_remaining")), "user_id", "left")
    rows = rows.na.fill(0, ["total_after", "merged", "duplicates_remaining"])
    return rows.withColumn("reduction", F.col("total_before") - F.col("total_after"))


def promotion_share(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """user_id, n_expected, n_promoted, rate: expected rows (key) that stand in some document of their user, whatever the case."""
    whole = documents.groupBy("user_id").agg(F.collect_list(F.lower("body")).alias("bodies"))
    there = F.exists(F.coalesce("bodies", F.array().cast("array<string>")), lambda body: F.contains(body, F.lower(F.coalesce(F.col("key"), F.lit("")))))
    rows = expected.join(whole, "user_id", "left").withColumn("there", there.cast("long"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_expected"), F.sum("there").alias("n_promoted"), F.avg("there").alias("rate"))


def greedy_extraction(found: DataFrame, truth: DataFrame) -> DataFrame:
    """user_id, tp, fp, fn, precision, recall, f1 of a one-to-one matching in the order of arrival; counts start anew in each scope."""
    pairs = matches(found, truth).select("user_id", F.col("f.arrival").alias("a"), F.col("t.id").alias("id"))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        taken, used = set(), set()
        for a, t in rows.sort_values(["a", "id"])[["a", "id"]].itertuples(index=False):
            if a not in used and t not in taken:
                used.add(a)
                taken.add(t)
        return pd.DataFrame({"user_id": rows["user_id"].iloc[:1], "tp": [len(used)]})

    tp = pairs.groupBy("user_id").applyInPandas(match, "user_id long, tp long")
    n = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("nf")).join(truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("nt")), "user_id", "full").join(tp, "user_id", "left")
    n = n.na.fill(0, ["nf", "nt", "tp"])
    p, r = F.coalesce(F.try_divide("tp", "nf"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "nt"), F.lit(0.0))
    return n.select("user_id", "tp", (F.col("nf") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def macro(rows: DataFrame, *measures: str) -> DataFrame:
    """The average over scopes of each measure, each scope alike."""
    return rows.agg(*[F.avg(m).alias(m) for m in measures])


def suite(parts: dict[str, DataFrame]) -> DataFrame:
    """metric, value: the averages over scopes of the columns named (part.column) in ``parts``, as one table."""
    return reduce(DataFrame.unionByName, [
        rows.agg(F.avg(name.split(".")[1]).alias("value")).select(F.lit(name).alias("metric"), "value") for name, rows in parts.items()
    ])
