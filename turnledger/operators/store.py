"""The keyed store: upsert with first-writer-wins keys, look-ups, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import boosted
from ..settings import DEFAULT, Settings


def upserted(arrivals: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The store after all ``arrivals`` in their order, without semantic deduplication.

    Of rows with one (scope, type, key) the first stays; each later one raises
    its mentions, boosts its confidence, and refreshes its recency. Rows
    without a key are never folded. One hash aggregate: copies of a hot key are
    combined before the shuffle.
    """
    scope = list(settings.scope)
    own = arrivals.withColumn("fold", F.when(F.coalesce("key", F.lit("")) == "", F.col("memory_id")))
    kept = [c for c in ("user_id", "memory_id", "value", "confidence", "turn_number", "source_text", "update_intent") if c in arrivals.columns and c not in scope]
    first = F.min_by(F.struct(*kept), "arrival").alias("f")
    rows = own.groupBy(*scope, "type", "key", "fold").agg(first, F.count(F.lit(1)).alias("n"), F.max_by("turn_number", "arrival").alias("last"), F.min("arrival").alias("arrival"))
    more = F.least(F.col("f.confidence") + settings.boost * (F.col("n") - 1), F.lit(settings.max_confidence))
    confidence = F.when(F.col("n") == 1, F.col("f.confidence")).otherwise(more)
    return rows.select(
        *scope, "type", "key", *[F.col(f"f.{c}").alias(c) for c in kept if c != "confidence"], confidence.alias("confidence"),
        F.col("n").cast("int").alias("mention_count"), (F.col("last") * 60.0).alias("recency_ts"), (F.col("f.turn_number") * 60.0).alias("timestamp"), "arrival",
    )


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids, "memory_id", "left_semi")


def by_type(memories: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    """Up to ``limit`` of a type in each scope, the most recent; ties by id."""
    w = Window.partitionBy("user_id").orderBy(F.col("recency_ts").desc(), "memory_id")
    return memories.where(F.col("type") == kind).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def recent(memories: DataFrame, limit: int = 20) -> DataFrame:
    """The most recent of each scope, newest first, superseded ones among them; ties by id, the last first."""
    w = Window.partitionBy("user_id").orderBy(F.col("recency_ts").desc(), F.col("memory_id").desc())
    return memories.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def oldest(memories: DataFrame, limit: int = 10_000) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("recency_ts", "memory_id")
    return memories.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def counts(memories: DataFrame) -> DataFrame:
    """Rows by type, superseded and promoted ones too."""
    return memories.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def counts_by_type(memories: DataFrame) -> DataFrame:
    """user_id, by_type: the types that a scope has, with their numbers, as type=n in the order of their names."""
    by = memories.groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n"))
    one = F.concat("type", F.lit("="), F.col("n").cast("string"))
    return by.groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_list(one))).alias("by_type"))


def by_type_and_key(memories: DataFrame, kind: str, key: str) -> DataFrame:
    return memories.where((F.col("type") == kind) & (F.col("key") == key))


def deleted(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The store without the ids; the key is free again, as it is a column of the row."""
    return memories.join(ids, "memory_id", "left_anti")


def cleared(memories: DataFrame) -> DataFrame:
    return memories.where(F.lit(False))


def superseded(memories: DataFrame, links: DataFrame) -> DataFrame:
    """Sets superseded_by and supersedes from links (old_id, new_id, at); of several links of a row the last counts, and both ends must be there."""
    ids = memories.select("memory_id")
    valid = links.join(ids.withColumnRenamed("memory_id", "old_id"), "old_id", "left_semi").join(ids.withColumnRenamed("memory_id", "new_id"), "new_id", "left_semi")
    by = valid.groupBy(F.col("old_id").alias("memory_id")).agg(F.max_by("new_id", "at").alias("superseded_by"))
    of = valid.groupBy(F.col("new_id").alias("memory_id")).agg(F.max_by("old_id", "at").alias("supersedes"))
    return memories.drop("superseded_by", "supersedes").join(by, "memory_id", "left").join(of, "memory_id", "left")


def update_links(memories: DataFrame) -> DataFrame:
    """Links by which a memory that announces an update supersedes the one of its type stored just before it."""
    w = Window.partitionBy("user_id", "type").orderBy("arrival")
    rows = memories.withColumn("old_id", F.lag("memory_id").over(w))
    return rows.where("update_intent and old_id is not null").select("old_id", F.col("memory_id").alias("new_id"), F.col("arrival").alias("at"))


def active(memories: DataFrame) -> DataFrame:
    return memories.where(F.coalesce("superseded_by", F.lit("")).isin("", "None"))


def with_mention(memories: DataFrame, ids: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Boosts the rows of ``ids`` (memory_id, once for each mention)."""
    hits = ids.groupBy("memory_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = memories.join(hits, "memory_id", "left")
    grown = F.aggregate(F.sequence(F.lit(1), F.col("hits")), F.col("confidence"), lambda c, _: boosted(c, settings.boost, settings.max_confidence))
    return rows.withColumn("confidence", F.when(F.col("hits") > 0, grown).otherwise(F.col("confidence"))).withColumn(
        "mention_count", F.col("mention_count") + F.coalesce("hits", F.lit(0)).cast("int")
    ).drop("hits")


def with_access(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts accesses (memory_id, turn): one more for each, and the last turn."""
    seen = hits.groupBy("memory_id").agg(F.count(F.lit(1)).cast("int").alias("k"), F.max("turn").alias("at"))
    rows = memories.join(seen, "memory_id", "left")
    return rows.withColumns({
        "access_count": F.col("access_count") + F.coalesce("k", F.lit(0)), "last_accessed_turn": F.coalesce("at", "last_accessed_turn"),
    }).drop("k", "at")


def with_recency(memories: DataFrame, seen: DataFrame) -> DataFrame:
    """Sets the recency of the rows of ``seen`` (memory_id, at); of several the last counts."""
    last = seen.groupBy("memory_id").agg(F.max("at").alias("__at"))
    return memories.join(last, "memory_id", "left").withColumn("recency_ts", F.coalesce("__at", "recency_ts")).drop("__at")


def with_field(memories: DataFrame, ids: DataFrame, name: str, value) -> DataFrame:
    marked = ids.select("memory_id").distinct().withColumn("__hit", F.lit(True))
    return memories.join(marked, "memory_id", "left").withColumn(name, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(name))).drop("__hit")
