"""Core-memory documents as rows: user_id, file, section, pos, line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import DOCUMENT_TITLES, PROMOTION_TARGET


def templates(users: DataFrame, date: str | None = None) -> DataFrame:
    """The empty documents of each user: user_id, file, place, title, section, updated (the date given, else today's)."""
    today = F.date_format(F.current_date(), "yyyy-MM-dd") if date is None else F.lit(date)
    made = [F.struct(F.lit(f).alias("file"), F.lit(k).alias("place"), F.lit(DOCUMENT_TITLES[f]).alias("title"), F.lit(s).alias("section")) for k, (f, s) in enumerate(PROMOTION_TARGET.values())]
    return users.select("user_id").distinct().select("user_id", F.inline(F.array(*made))).withColumn("updated", today)


def whole(templates_: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """user_id, file, body: each document as it is read and written, with its title, the date of its last update, and its section's lines."""
    rows = templates_
    if lines is None:
        rows = rows.withColumn("l", F.array().cast("array<struct<pos:int,line:string>>"))
    else:
        own = lines.groupBy("user_id", "file", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
        rows = rows.join(own, ["user_id", "file", "section"], "left").withColumn("l", F.coalesce("l", F.array().cast(own.schema["l"].dataType)))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Last Updated:** "), F.col("updated"), F.lit("\n\n## "), F.col("section"), F.lit("\n"))
    text = F.concat(head, F.concat_ws("", F.transform("l.line", lambda x: F.concat(x, F.lit("\n")))), F.lit("\n"))
    return rows.select("user_id", "file", text.alias("body"))


def touched(templates_: DataFrame, before: DataFrame, after: DataFrame, date: str) -> DataFrame:
    """The templates with the date of the documents whose fields an update changed; lines that were added do not count."""
    by = ["user_id", "file", "section", "pos"]
    changed = before.join(after.withColumnRenamed("line", "new"), by).where("line != new").select("user_id", "file").distinct().withColumn("__new", F.lit(date))
    return templates_.join(changed, ["user_id", "file"], "left").withColumn("updated", F.coalesce("__new", "updated")).drop("__new")


def edited(documents: DataFrame, file: str, section: str, field: str, value: str, date: str) -> DataFrame:
    """Documents (user_id, file, body) with a field set where it stands: the first line that starts with it in the first section whose head holds the name; the date follows.

    Documents without the section or the field stay as they are.
    """
    start = f"- **{field}:**"
    lines = F.split("body", "\n")
    head = lambda x: x.startswith("## ") & F.contains(x, F.lit(section))
    # state of a walk over the lines: inside (in the section), done, and the lines so far
    step = lambda a, x: F.struct(
        F.when(x.startswith("##"), head(x)).otherwise(a["inside"]).alias("inside"),
        (a["done"] | (a["inside"] & x.startswith(start))).alias("done"),
        F.concat(a["out"], F.array(F.when(a["inside"] & x.startswith(start) & ~a["done"], F.lit(f"{start} {value}")).otherwise(x))).alias("out"),
    )
    walked = F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out")), step)
    dated = F.transform(walked["out"], lambda x: F.when(x.startswith("**Last Updated:**"), F.lit(f"**Last Updated:** {date}")).otherwise(x))
    body = F.when((F.col("file") == file) & walked["done"], F.array_join(dated, "\n")).otherwise(F.col("body"))
    return documents.select("user_id", "file", body.alias("body"))


def path_of(root: str, user: str, file: str) -> str:
    """Where a document lies."""
    return f"{root.rstrip('/')}/{user}/{file}"


def write_documents(documents: DataFrame, root: str) -> None:
    """Writes documents to ``root``/user/file through Spark's file system, each in the task that has it."""
    rows = documents.select(F.col("user_id").cast("string").alias("user"), "file", "body")
    rows.write.mode("overwrite").partitionBy("user", "file").text(root)


def appended(lines: DataFrame, new: DataFrame) -> DataFrame:
    """Lines with ``new`` ones (user_id, file, section, at, line) right after the header, the newest first."""
    w = Window.partitionBy("user_id", "file", "section").orderBy(F.col("at").desc())
    placed = new.withColumn("pos", F.row_number().over(w)).drop("at")
    moved = placed.groupBy("user_id", "file", "section").agg(F.max("pos").alias("by"))
    old = lines.join(moved, ["user_id", "file", "section"], "left").withColumn("pos", F.col("pos") + F.coalesce("by", F.lit(0))).drop("by")
    return placed.unionByName(old)


def updated(lines: DataFrame, field: str, value: str, section: str) -> DataFrame:
    """Sets a field: the first line of the section that starts with it."""
    start = f"- **{field}:**"
    w = Window.partitionBy("user_id", "file", "section").orderBy(F.col("line").startswith(start).desc(), "pos")
    rows = lines.withColumn("rn", F.row_number().over(w))
    hit = F.contains("section", F.lit(section)) & F.col("line").startswith(start) & (F.col("rn") == 1)
    return rows.withColumn("line", F.when(hit, F.lit(f"{start} {value}")).otherwise(F.col("line"))).drop("rn")


def rendered(lines: DataFrame) -> DataFrame:
    """user_id, file, body: the lines of each document in their order under their section."""
    sections = lines.groupBy("user_id", "file", "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.concat_ws("\n", F.col("l.line")))
    return sections.groupBy("user_id", "file").agg(F.array_sort(F.collect_list(F.struct("section", body.alias("b")))).alias("s")).select(
        "user_id", "file", F.concat_ws("\n\n", F.col("s.b")).alias("body")
    )


def joined(documents: DataFrame) -> DataFrame:
    """user_id, core: the documents that are not blank, in their fixed order, each under its name."""
    order = {f: k for k, (f, _) in enumerate(PROMOTION_TARGET.values())}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("file"))
    part = F.concat(F.lit("=== "), F.col("file"), F.lit(" ===\n"), F.col("body"), F.lit("\n"))
    own = documents.where(F.trim("body") != "").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), part.alias("t")))).alias("s"))
    return own.select("user_id", F.concat_ws("\n", F.col("s.t")).alias("core"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below ``path``/user/, or documents as ``write_documents`` leaves them, as user_id, file, body."""
    written = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("body"))
    part = lambda name: F.regexp_extract("p", rf"/{name}=([^/]+)/", 1)
    keyed = written.where(part("file") != "")
    plain = written.where((part("file") == "") & F.col("p").endswith(".md"))
    laid = keyed.select(part("user").alias("user_id"), part("file").alias("file"), F.regexp_replace("body", r"\n\z", "").alias("body"))
    return laid.unionByName(plain.select(F.element_at(F.split("p", "/"), -2).alias("user_id"), F.element_at(F.split("p", "/"), -1).alias("file"), "body"))
