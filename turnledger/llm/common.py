"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of this subpackage defines it.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place, but only in local
    mode, where there is one machine; on a cluster that would lose data, so
    there it is an error.
    """
    sc = spark.sparkContext
    if configured := sc.getConf().get("spark.checkpoint.dir"):
        return configured.rstrip("/")
    jsc = sc._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpus-")
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in one folder an application, which ``cleared`` deletes."""
    return f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    It cuts the lineage: what follows rereads the table, also after the loss
    of an executor, and sees the same rows each time.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reaches."""
    store, where = _files(spark, path)
    return store.exists(where)


def cleared(spark: SparkSession) -> None:
    """Deletes what this application's operators have written to the shared folder; their results can no longer be read then."""
    store, where = _files(spark, f"{shared_dir(spark)}/corpus-{spark.sparkContext.applicationId}")
    store.delete(where, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no classifier may learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == 0


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Bounds the Arrow batches that Python workers get by rows and bytes, as a row here is a whole document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
