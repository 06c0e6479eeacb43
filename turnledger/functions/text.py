"""Column functions that the operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import GREETINGS, KEYWORDS, MODIFIERS, SPECIFIC, UPDATES


def stripped(c: Column) -> Column:
    """Without white space at the ends, tabs and newlines included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def added(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def sensory_score(message: Column) -> Column:
    """How likely a message holds something to remember, 0 to 1; 0 for greetings and what is too short."""
    low = stripped(F.lower(message))
    one = lambda c: c.cast("double")
    words = F.array(*[F.lit(w) for words in KEYWORDS.values() for w in words])
    count = lambda held: F.aggregate(words, F.lit(0), lambda a, w: a + F.contains(held, w).cast("int"))
    keywords = F.get(F.transform(F.array(low), count), 0)  # the text is lowered once, and the code stays small
    specific = added([message.rlike(p).cast("int") for p in SPECIFIC])
    score = (
        F.least(F.length(message) / F.lit(100.0), F.lit(1.0)) * 0.3 + F.least(keywords / F.lit(3.0), F.lit(1.0)) * 0.4
        + one(F.contains(message, F.lit("?"))) * 0.15 + F.least(specific / F.lit(3.0), F.lit(1.0)) * 0.15
    )
    return F.when((F.length(low) < 5) | low.isin(GREETINGS), F.lit(0.0)).otherwise(score)


def modified(confidence: Column, source: Column) -> Column:
    """Confidence moved by words of certainty in the source, kept within 0 and 1."""
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(d).alias("d")) for w, d in MODIFIERS.items()])
    start = F.struct(confidence.alias("c"), F.lower(source).alias("t"))
    move = lambda s: F.aggregate(words, s["c"], lambda a, m: a + F.when(F.contains(s["t"], m["w"]), m["d"]).otherwise(0.0))
    moved = F.get(F.transform(F.array(start), move), 0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))


def update_intent(message: Column) -> Column:
    return any_of([F.lower(message).rlike(p) for p in UPDATES])


def boosted(confidence: Column, boost: float = 0.1, most: float = 0.95) -> Column:
    """One mention more; what is above the limit comes down to it."""
    return F.least(confidence + boost, F.lit(most))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles, 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)


def similarity(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def point_id(memory_id: Column) -> Column:
    """The first 64 bits of the digest, unsigned."""
    return F.conv(F.substring(F.md5(memory_id), 1, 16), 16, 10).cast("decimal(20,0)")


def embed_text(key: Column, value: Column, kind: Column) -> Column:
    """What a memory is embedded by: its parts that are there, in order."""
    return F.concat_ws(" | ", F.nullif(key, F.lit("")), F.nullif(value, F.lit("")), F.concat(F.lit("type: "), F.nullif(kind, F.lit(""))))
