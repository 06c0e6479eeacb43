"""Retrieval: branches of candidates, their union, ranking, and the prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import CORE_HEAD, DEFAULT, PROMPT_ORDER, RETRIEVED_HEAD, TYPE_PRIORITY, Settings
from .store import active, recent


def type_priority(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv]), kind), F.lit(0.5))


def typed(memories: DataFrame, kinds: tuple[str, ...], limit: int) -> DataFrame:
    """Up to ``limit`` of each type in each scope, the most recent."""
    w = Window.partitionBy("user_id", "type").orderBy(F.col("recency_ts").desc(), "memory_id")
    return memories.where(F.col("type").isin(*kinds)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


def candidates(memories: DataFrame, hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """user_id, memory_id, semantic_score, branch: the union of the branches, one row a memory.

    The first branch that found a memory gives its score: the vector search
    (``hits``: user_id, memory_id, score), the most recent, the types that are
    always on, the types asked for. Always-on types score at least their floor.
    """
    branches = [
        hits.select("user_id", "memory_id", F.col("score").alias("s"), F.lit(1).alias("branch")),
        recent(memories, settings.recency_limit).select("user_id", "memory_id", F.lit(settings.recency_score).alias("s"), F.lit(2).alias("branch")),
        typed(memories, settings.always_on, settings.always_on_limit).select("user_id", "memory_id", F.lit(settings.always_on_floor).alias("s"), F.lit(3).alias("branch")),
    ]
    if other := tuple(t for t in settings.priority_types if t not in settings.always_on):
        branches.append(typed(memories, other, settings.priority_limit).select("user_id", "memory_id", F.lit(settings.priority_score).alias("s"), F.lit(4).alias("branch")))
    every = reduce(DataFrame.unionByName, branches)
    one = every.groupBy("user_id", "memory_id").agg(F.min_by("s", "branch").alias("s"), F.min("branch").alias("branch"), F.max(F.col("branch") == 3).alias("on"))
    floor = F.when(F.col("on"), F.greatest("s", F.lit(settings.always_on_floor))).otherwise(F.col("s"))
    return one.select("user_id", "memory_id", floor.alias("semantic_score"), "branch")


def ranked(memories: DataFrame, settings: Settings = DEFAULT, signals: int = 5) -> DataFrame:
    """Adds the signals and retrieval_score to rows with semantic_score and now (the turn of the query)."""
    ago = lambda c: F.greatest(F.lit(0), F.col("now") - F.col(c))
    rows = memories.withColumn("type_score", type_priority(F.col("type"))).withColumn("recency_score", F.exp(-settings.recency_rate * ago("turn_number")))
    if signals == 3:
        w = settings.weights3
        return rows.withColumn("retrieval_score", w["semantic"] * F.col("semantic_score") + w["type"] * F.col("type_score") + w["recency"] * F.col("recency_score"))
    w, part = settings.weights5, F.least(F.lit(1.0), F.col("access_count") / F.lit(float(settings.frequency_max)))
    lately = F.exp(-settings.frequency_rate * ago("last_accessed_turn"))
    rows = rows.withColumn("frequency_score", (1 - settings.frequency_recent) * part + settings.frequency_recent * lately * part)
    rows = rows.withColumn("confidence_score", F.coalesce("confidence", F.lit(0.5)))
    return rows.withColumn("retrieval_score", reduce(lambda a, b: a + b, [w[s] * F.col(f"{s}_score") for s in w]))


def top(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Without superseded rows, the best of each scope that fit the budget, with their rank."""
    w = Window.partitionBy("user_id").orderBy(F.col("retrieval_score").desc(), "branch", "memory_id")
    return active(rows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(settings.top, settings.token_budget // settings.tokens_per_memory))


def hybrid(memories: DataFrame, hits: DataFrame, now: DataFrame, settings: Settings = DEFAULT, signals: int = 5, payload: DataFrame | None = None) -> DataFrame:
    """The whole retrieval for each scope at its turn (``now``: user_id, now).

    A hit that the store does not hold takes what the vectors carry of it
    (``payload``: user_id, memory_id, type, key, value, confidence,
    turn_number), as never accessed; without a payload it is left out.
    """
    found = candidates(memories, hits, settings)
    rows = memories.drop("now").join(found, ["user_id", "memory_id"])
    if payload is not None:
        lost = payload.join(memories.select("user_id", "memory_id"), ["user_id", "memory_id"], "left_anti").join(found, ["user_id", "memory_id"])
        lost = lost.withColumn("access_count", F.lit(0)).withColumn("last_accessed_turn", F.col("turn_number")).withColumn("mention_count", F.lit(1))
        rows = rows.unionByName(lost, allowMissingColumns=True)
    return top(ranked(rows.join(now, "user_id"), settings, signals), settings)


def retrieved(memories: DataFrame, hits: DataFrame | None = None, now: DataFrame | None = None, settings: Settings = DEFAULT, payload: DataFrame | None = None) -> DataFrame:
    """Retrieval as the settings have it: with vectors and 5 or 3 signals, or the basic form where these are off or there are no hits."""
    if settings.semantic and hits is not None and now is not None:
        return hybrid(memories, hits, now, settings, settings.signals, payload)
    return basic(memories, settings)


def basic(memories: DataFrame, settings: Settings = DEFAULT, limit: int = 30) -> DataFrame:
    """Retrieval without vectors: always-on types score 1, the i-th most recent 0.5 * 0.9^i, types asked for 0.7 if new."""
    on = typed(memories, settings.always_on, settings.always_on_limit).select("user_id", "memory_id", F.lit(1.0).alias("s"), F.lit(1).alias("branch"))
    late = recent(memories, limit).where(~F.col("type").isin(*settings.always_on))
    late = late.select("user_id", "memory_id", (0.5 * F.pow(F.lit(0.9), F.col("rn") - 1)).alias("s"), F.lit(2).alias("branch"))
    every = on.unionByName(late)
    if other := tuple(t for t in settings.priority_types if t not in settings.always_on):
        asked = typed(memories, other, settings.priority_limit).select("user_id", "memory_id", F.lit(0.7).alias("s"), F.lit(3).alias("branch"))
        every = every.unionByName(asked.join(every, ["user_id", "memory_id"], "left_anti"))
    one = every.groupBy("user_id", "memory_id").agg(F.max("s").alias("retrieval_score"), F.min("branch").alias("branch"))
    return top(memories.join(one, ["user_id", "memory_id"]), settings)


def prompt(rows: DataFrame) -> DataFrame:
    """user_id, prompt: sections by type in a fixed order, a line a memory in its rank; other types are left out."""
    percent = F.bround(F.col("confidence") * 100, 0).cast("int").cast("string")
    line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("value"), F.lit(" [turn "), F.col("turn_number").cast("string"), F.lit(", "), percent, F.lit("% confident]"))
    section = F.array_position(F.array(*map(F.lit, PROMPT_ORDER)), F.col("type")).cast("int")
    lines = rows.withColumn("section", section).where("section > 0").withColumn("line", line)
    parts = lines.groupBy("user_id", "section", "type").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    body = F.concat(F.lit("=== "), F.upper("type"), F.lit(" ===\n"), F.concat_ws("\n", F.col("l.line")))
    whole = parts.select("user_id", F.struct("section", body.alias("body")).alias("s")).groupBy("user_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select("user_id", F.concat_ws("\n\n", F.col("s.body")).alias("prompt"))


def whole_prompt(core: DataFrame, rows: DataFrame) -> DataFrame:
    """user_id, context: the core memory (user_id, core) and the retrieved memories, each under its head, where there are any."""
    both = core.join(prompt(rows), "user_id", "full")
    part = lambda head, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{head}\n\n"), F.col(c)))
    return both.select("user_id", F.concat_ws("\n\n", part(CORE_HEAD, "core"), part(RETRIEVED_HEAD, "prompt")).alias("context"))


def active_memories(rows: DataFrame) -> DataFrame:
    """What a turn reports of each retrieved memory; the access of this turn counts already."""
    content = F.concat(F.coalesce("key", F.lit("unknown")), F.lit(": "), F.coalesce("value", F.lit("")))
    return rows.select("user_id", "rank", "memory_id", content.alias("content"), "type", F.col("turn_number").alias("origin_turn"), "now", "confidence", "mention_count", (F.col("access_count") + 1).alias("access_count"))
