"""Exact deduplication by a stateful stream.

Each document is reduced to the SHA-256 digest of its normalised text, its
identifiers and a locator of its content: the file that holds it and its row
there. A Structured Streaming query folds these rows into keyed state held by
RocksDB on disk; the state has no watermark and never expires, so a copy is
found however late it comes. Spark combines the rows of a digest in each task
before the shuffle, so one digest shared by a third of all rows costs one row a
task. State is read back with the state data source once the available input
is used up.

A row is known by its batch and its number there, which are written with its
digest before anything looks at them, so they stay when a job is repeated or a
later batch is folded into the same state.

A digest seen twice is a hit, and hits are confirmed on the full bytes: their
texts are read by their locators and compared with the text of the row that
stays. Should a digest ever stand for two texts, its group is split by the
texts themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, scratch, text_or_empty, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream. A state store of a few rows would otherwise reserve megabytes of disk.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A digest is hot above this part of all rows; so there are fewer hot digests than this number, and they can be broadcast.
HOT_PART = 1024
#: Parts that the rows of a hot digest are joined in, and copies of one text that one task compares at most.
SALTS, GROUP_ROWS = 64, 1000


def normalised(column: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty.

    Only runs that differ from one space are matched, which gives the same
    text with far fewer matches.
    """
    return F.regexp_replace(text_or_empty(column), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def located(docs: DataFrame, copy: str) -> DataFrame:
    """doc_id, text, file, at (the row there) and row (all columns) of every row; a table that comes from no file is written to ``copy`` first."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        if "_metadata" not in docs.columns:
            return docs.select(*own, *place)
    except AnalysisException:
        pass
    plain = docs.select(*own)
    if not exists(docs.sparkSession, f"{copy}/_SUCCESS"):
        plain.write.mode("overwrite").parquet(copy)
    return docs.sparkSession.read.schema(plain.schema).parquet(copy).select("doc_id", "text", "row", *place)


def fingerprints(rows: DataFrame, batch: str) -> DataFrame:
    """row (batch, number; unique), doc_id, digest, file, at: what the state retains instead of texts."""
    row = F.struct(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("n"))
    return rows.select(row.alias("row"), "doc_id", F.sha2(normalised(), 256).alias("digest"), "file", "at")


def first_row() -> Column:
    """Of the rows of a group the one that stays: the smallest doc_id, null after all others, then the first row."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "file", "at"))


def fold(spark: SparkSession, source: str, checkpoint: str, schema, files_per_trigger: int = 256) -> DataFrame:
    """Folds all rows below ``source`` into the state at ``checkpoint`` and returns the state.

    Calling it again with the same checkpoint takes up only new files; a
    restart after a failure goes on from the last committed micro-batch.
    Returns digest, first (none, doc_id, row, file, at), group_size.
    """
    before = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
        state = rows.groupBy("digest").agg(first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
        query = (
            state.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stored = spark.read.format("statestore").load(checkpoint)
    first, count = (f"value.{name}" for name in stored.schema["value"].dataType.names)
    return stored.select(F.col("key.digest").alias("digest"), F.col(first).alias("first"), F.col(count).alias("group_size"))


def grouped(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` with first and group_size of their digests; the rows of hot digests are joined in parts."""
    n = rows.count()
    hot = F.col("group_size") > F.lit(max(1, n) / HOT_PART)
    names = F.broadcast(state.where(hot).select("digest", F.lit(SALTS).alias("salts")))
    salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = rows.join(names, "digest", "left").withColumn("salt", salt).drop("salts")
    spread = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))))
    return dealt.join(spread, ["digest", "salt"]).drop("salt")


def regrouped(rows: DataFrame) -> DataFrame:
    """Groups of digests that stand for several texts, taken anew by the texts; ``rows`` has norm besides row, doc_id, digest, file, at."""
    groups = rows.groupBy("digest", "norm").agg(first_row().alias("first"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, ["digest", "norm"]).drop("norm")


def texts_of(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """``hits`` (file, at) with norm: the normalised texts that stand there, from ``rows`` (file, at, text)."""
    return rows.select("file", "at", normalised().alias("norm")).join(hits, ["file", "at"])


def exact_groups(spark: SparkSession, docs: DataFrame, state: str | None = None, batch: str = "") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, file, at.

    Of equal texts the row with the smallest doc_id stays (of rows that repeat
    one doc_id, one). Null texts are empty texts; empty texts are equal to each
    other; a text of any length is read whole. A null doc_id orders behind all
    others. An empty table gives an empty result; other columns of ``docs`` are
    not looked at.

    With a folder ``state`` in shared storage the state goes on: each call folds
    a further ``batch`` into it and returns the rows of all batches, with one row
    kept of each text in all of them. A batch that is there already is not
    written again, so a call that failed can be repeated. The files of earlier
    batches must still be there.
    """
    home = state or scratch(spark, "dedup")
    return judged(spark, located(docs, f"{home}/content/{batch or 'all'}").drop("row"), home, batch)


def judged(spark: SparkSession, own: DataFrame, home: str, batch: str = "") -> DataFrame:
    """``exact_groups`` of rows with doc_id, text, file and at."""
    prints = f"{home}/digests/{batch or 'all'}"
    if not exists(spark, f"{prints}/_SUCCESS"):
        fingerprints(own, batch).write.mode("overwrite").parquet(prints)
    rows = spark.read.parquet(f"{home}/digests/*")
    folded = written(fold(spark, f"{home}/digests/*", f"{home}/state", rows.schema), "dedup-state")
    every = written(grouped(rows, folded), "dedup-groups")
    hits = every.where("group_size > 1")
    salts = F.ceil(F.col("group_size") / GROUP_ROWS).cast("int")
    wanted = hits.select("file", "at", "digest", salts.alias("salts"), (F.col("row") == F.col("first.row")).alias("keeps"))
    there = own
    if earlier := [r.file for r in hits.where(F.col("row.batch") != batch).select("file").distinct().collect()]:
        there = own.select("file", "at", "text").unionByName(
            spark.read.schema("text string").parquet(*earlier).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "text")
        ).dropDuplicates(["file", "at"])
    texts = written(texts_of(wanted, there), "dedup-hits")
    kept = texts.where("keeps").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    kept = kept.select("digest", "salt", F.col("norm").alias("kept_norm"))
    members = texts.where("not keeps").withColumn("salt", F.pmod(F.xxhash64("file", "at"), F.col("salts")).cast("int"))
    unlike = members.join(kept, ["digest", "salt"]).where("norm != kept_norm").select("digest").distinct()
    unlike = written(unlike, "dedup-collisions")
    if not unlike.isEmpty():
        again = every.drop("first", "group_size").join(unlike, "digest", "left_semi").join(texts.select("file", "at", "norm"), ["file", "at"])
        every = every.join(unlike, "digest", "left_anti").unionByName(regrouped(again))
    return every.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"), F.col("digest").alias("text_sha256"), "file", "at",
    )


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Null texts are empty texts, of which one stays; rows without a doc_id stay
    where no other row has their text. Of rows that repeat a doc_id and a text
    one stays. An empty table gives an empty result; columns of any name pass.
    """
    home = scratch(spark, "dedup")
    own = located(docs, f"{home}/content/all")
    keep = judged(spark, own.drop("row"), home).where("kept").select("file", "at")
    return own.join(keep, ["file", "at"], "left_semi").select("row.*")
