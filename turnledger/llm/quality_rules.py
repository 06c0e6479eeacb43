"""Quality rules: per-document statistics and cross-document line frequency.

Everything is a built-in function. One pass over the texts leaves a narrow
table: the statistics, a digest of the text, and for each line a hash of its
normalised form and its words. Lines are counted by the distinct texts of a
host (the source) that hold them, so exact copies of a page do not make its
lines boilerplate. Lines above the limit are removed, and documents that lose
more than a part of their words are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, text_or_empty, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: A line is removed if more texts of its host hold it than this, and more than this part of them.
MIN_LINE_TEXTS = 20
MAX_LINE_SHARE = 0.02
#: A document is rejected if removed lines hold more than this part of its words.
MAX_REMOVED = 0.5
#: One frequent line may stand in a third of all documents; its rows are joined in so many parts.
SALTS = 16
#: What a row is found by again in the texts; rows that agree in it are judged alike.
KEY = ("doc_id", "host", "digest")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def covered(starts: Column, width: int) -> Column:
    """Places that windows of ``width`` cover, from the sorted starts."""
    begin = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        starts, begin,
        lambda a, x: F.struct((a["total"] + width - F.greatest(F.lit(0), a["end"] - x)).alias("total"), (x + width).alias("end")),
        lambda a: a["total"],
    )


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words in windows of ``width`` words that stand in the text twice or more.

    Windows are known by a 64-bit hash of their words. Only where some hash
    repeats are hashes sorted with their places; the sort brings equal windows
    together, so the work stays near the number of words.
    """

    def marked(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(z: Column) -> Column:
            twin = lambda e, k: (F.get(z, k - 1)["h"] == e["h"]) | (F.get(z, k + 1)["h"] == e["h"])
            return F.sort_array(F.filter(F.transform(z, lambda e, k: F.when(F.coalesce(twin(e, k), F.lit(False)), e["i"])), lambda i: i.isNotNull()))

        return covered(let(placed, starts), width)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))
        return F.when(F.size(w) <= width, F.lit(0)).otherwise(
            let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), marked(h)).otherwise(F.lit(0)))
        )

    return let(words, of).cast("long")


def line_form(line: Column) -> Column:
    """A line for comparison: lower case, digits alike, single spaces, none at its ends."""
    spaced = F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " ")
    return F.btrim(F.regexp_replace(spaced, "[0-9]", "0"))


def statistics(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with the statistics, the digest, the host, and lines (hash of the form, words, digest)."""
    text = text_or_empty()
    own = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"), text.alias("text"),
    )
    lines = F.filter(F.split(F.col("text"), "\n"), lambda line: F.translate(line, SPACES, "") != "")
    own = own.withColumn("words", words_of(F.col("text"))).withColumn("lines", lines)
    return own.select(
        "row_id", "doc_id", "host", F.xxhash64("text").alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda line: F.struct(
            F.xxhash64(line_form(line)).alias("line"), F.size(words_of(line)).alias("line_words"), F.unhex(F.left(F.sha2(line, 256), F.lit(32))).alias("sha"),
        )).alias("lines"),
    )


def frequent_lines(rows: DataFrame, lines: DataFrame, min_texts: int, max_share: float) -> DataFrame:
    """host, line of the lines above the limits; texts are counted, not copies of them."""
    per_host = rows.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    counts = lines.select("host", "line", "digest").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts"))
    counts = counts.where(F.col("texts") > min_texts)
    other = per_host.withColumnRenamed("host", "host_")
    return counts.join(other, F.col("host").eqNullSafe(F.col("host_"))).where(F.col("texts") > max_share * F.col("host_texts")).select("host", "line")


def judged(docs: DataFrame, min_texts: int = MIN_LINE_TEXTS, max_share: float = MAX_LINE_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The rows of ``quality_rules`` with their host and removed_lines, the hashes of their frequent lines (null: none)."""
    rows = written(statistics(docs), "rules-rows")
    lines = rows.select("row_id", "host", "digest", F.inline("lines")).drop("sha")
    frequent = frequent_lines(rows, lines, min_texts, max_share)
    frequent = frequent.select(
        F.col("host").alias("host_"), F.col("line").alias("line_"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_")
    )
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    same = F.col("host").eqNullSafe(F.col("host_")) & (F.col("line") == F.col("line_")) & (F.col("salt") == F.col("salt_"))
    found = salted.join(frequent, same)
    removed = found.groupBy("row_id").agg(F.sum("line_words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = rows.join(removed, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")))


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose forms have these hashes; the other lines stay as they are."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(hashes, F.xxhash64(line_form(line)))), "\n")


def quality_rules(spark: SparkSession, docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, removed_words, base_failed, kept, left_sha256.

    left_sha256 is a digest of what is left without the frequent lines: the
    SHA-256 digest of the first 32 hex digits of those of the lines with a word
    that stay, in order. Null and empty texts have no words and fail the base rules; a text of any length is
    read whole. A null source is a host of its own, and a null doc_id a
    document like others. Repeated rows are judged alike. An empty table gives
    an empty result; other columns are not looked at. ``limits`` are those of
    ``judged``.
    """
    removed = F.coalesce("removed_lines", F.array().cast("array<long>"))
    left = F.filter("lines", lambda line: ~F.array_contains(removed, line["line"]))
    return judged(docs, **limits).select(
        "row_id", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept",
        F.sha2(F.array_join(F.transform(left, lambda line: F.lower(F.hex(line["sha"]))), ""), 256).alias("left_sha256"),
    )


def passing(spark: SparkSession, docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without their frequent lines, with all their columns.

    Each row is judged by its own text, also where doc_ids repeat or are null;
    rows with the same doc_id, source and text are judged alike. The rules judge
    the texts as they were. n_chars, where it is present, follows a changed
    text. Null and empty texts go; an empty table gives an empty result; columns
    of any other name pass as they are.
    """
    rows = judged(docs, **limits).where("kept").select(*[F.col(c).alias(f"__{c}") for c in KEY], F.col("removed_lines").alias("__lines"))
    rows = rows.dropDuplicates([f"__{c}" for c in KEY])
    own = [docs["doc_id"].cast("long"), docs["source"].cast("string"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))]
    same = reduce(lambda a, b: a & b, [x.eqNullSafe(rows[f"__{c}"]) for x, c in zip(own, KEY)])
    cut = rows["__lines"].isNotNull()
    text = F.when(cut, without_lines(docs["text"], rows["__lines"])).otherwise(docs["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return docs.join(rows, same).select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
