"""Extraction: from messages to typed memories, a scan of the turns each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import modified, sensory_score, stripped, update_intent
from ..settings import DEFAULT, NO_GROUP, PATTERNS, Settings


def scored(turns: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Turns with their sensory score, and whether they pass."""
    return turns.withColumn("score", sensory_score(F.col("text"))).withColumn("passed", F.col("score") >= settings.sensory_threshold)


def _matches(number: int, kind: str, key: str, confidence: float, lowered: bool, pattern: str) -> Column:
    text = F.lower("text") if lowered else F.col("text")
    two = key.endswith("{1}")
    groups = "(" in pattern.replace("(?:", "").replace(r"\(", "")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if groups else 0))
    record = lambda name, value, i: F.struct(
        F.lit(kind).alias("type"), name.alias("key"), value.alias("value"), F.lit(confidence).alias("base"),
        F.lit(number).alias("pattern"), i.cast("int").alias("match"),
    )
    if two:
        names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        stem = key.removesuffix("{1}")
        return F.transform(names, lambda x, i: record(F.concat(F.lit(stem), stripped(x)), stripped(F.element_at(values, i + 1)), i))
    return F.transform(found, lambda x, i: record(F.lit(key), stripped(x) if groups else F.lit(NO_GROUP), i))


def extracted(turns: DataFrame, only: str | None = None) -> DataFrame:
    """One row a match of the patterns, whatever the turn's score; ``only`` one type.

    All patterns are matched in one pass over the turns: their matches are
    joined to an array and laid out, not united.
    """
    own = [(k + 1, *p) for k, p in enumerate(PATTERNS) if only in (None, p[0])]
    every = F.concat(*[_matches(*p) for p in own])
    rows = turns.select("user_id", "turn_number", "text", F.inline(every))
    named = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("turn_number").cast("string"), F.col("pattern").cast("string"), F.col("match").cast("string")))
    return rows.select(
        "user_id", "turn_number", "type", "key", "value", modified(F.col("base"), F.col("text")).alias("confidence"), F.col("base"),
        (F.col("turn_number").cast("long") * 100_000 + F.col("pattern") * 1000 + F.col("match")).alias("arrival"),
        F.concat(F.lit("mem_"), F.left(named, F.lit(16))).alias("memory_id"), F.col("text").alias("source_text"),
        update_intent(F.col("text")).alias("update_intent"),
    )


def stored_candidates(turns: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What the first two stages would store: matches of passing turns with enough confidence."""
    return extracted(scored(turns, settings).where("passed").drop("score", "passed")).where(F.col("confidence") >= settings.min_confidence)


def escalation(turns: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per turn: score, matches, best confidence, and whether the model stage is needed; its hint is the first match's type."""
    passed = scored(turns, settings)
    found = extracted(passed.where("passed").select("user_id", "turn_number", "text"))
    found = found.groupBy("user_id", "turn_number").agg(F.count(F.lit(1)).alias("matches"), F.max("confidence").alias("best"), F.min_by("type", "arrival").alias("hint"))
    rows = passed.join(found, ["user_id", "turn_number"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    needs = F.col("passed") & F.when(F.col("matches") == 0, F.col("score") > settings.escalation_score).otherwise(F.col("best") < settings.escalation_confidence)
    return rows.select("user_id", "turn_number", "text", "score", "passed", "matches", "best", "hint", needs.alias("needs_model"))


def context(turns: DataFrame, size: int = 2) -> DataFrame:
    """Turns with the messages just before them, oldest first; "No prior context" where there are none."""
    w = Window.partitionBy("user_id").orderBy("turn_number").rowsBetween(-size, -1)
    return turns.withColumn("context", F.coalesce(F.nullif(F.concat_ws("\n", F.collect_list("text").over(w)), F.lit("")), F.lit("No prior context")))


def merged_stages(rows: DataFrame) -> DataFrame:
    """One row a (user, turn, type, key) of rows with stage 2 or 3: the last of stage 2, unless stage 3 is surer.

    Within stage 3 the surest row wins, the earlier of equals.
    """
    by = ["user_id", "turn_number", "type", "key"]
    last = rows.where("stage = 2").groupBy(by).agg(F.max_by(F.struct("value", "confidence"), "arrival").alias("two"))
    best = rows.where("stage = 3").groupBy(by).agg(F.max(F.struct("confidence", (-F.col("arrival")).alias("early"), "value")).alias("three"))
    both = last.join(best, by, "full")
    three = F.col("two").isNull() | (F.coalesce(F.col("three.confidence"), F.lit(-1.0)) > F.col("two.confidence"))
    return both.select(
        *by, F.when(three, F.col("three.value")).otherwise(F.col("two.value")).alias("value"),
        F.when(three, F.col("three.confidence")).otherwise(F.col("two.confidence")).alias("confidence"), F.when(three, 3).otherwise(2).alias("stage"),
    )
