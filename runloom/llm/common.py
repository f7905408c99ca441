"""Helpers shared by the corpus operators: table access, scratch tables, text normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte table that lower-cases A-Z only; other bytes of UTF-8 stay.
LOWER_AZ = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir).

    Where none is set, a temporary one; on a cluster, whose hosts could not read that, this is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        shared = "file://" + tempfile.mkdtemp(prefix="runloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of df by a Parquet table in the shared folder.

    One execution (checkpoint() would run the plan twice), compressed, and
    readable after the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Delete a table that `written` made, once nothing that is still to run reads it."""
    paths = table.inputFiles()
    if paths:
        drop_path(table.sparkSession, paths[0].rsplit("/", 1)[0])


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it is proven to have at most so many rows, else df as it is."""
    return F.broadcast(df) if small_enough(df, rows) else df


#: Rows and bytes of text that go to a Python worker and back at once. Spark's 10,000 rows of long texts take hundreds of
#: megabytes outside the heap of an executor.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are bounded by BATCH_ROWS and BATCH_BYTES.

    The setting is read when a query runs, so it stays for the session; results do not depend on it.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def place_of(h: Column) -> Column:
    """A 64-bit hash as its place from 0 to 1."""
    return (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


#: Counts below this have bins of their own; beyond, each doubling has as many as the second.
FINE, BINS = 1024, 64


def commonest(counts: DataFrame, most: int) -> list:
    """Rows of counts(n, ...) with the largest n, at most `most` of them: all those from some n on.

    A histogram of some thousand bins tells which n that is, so no more rows than these reach the driver.
    """
    n = F.col("n")
    bin_of = F.when(n < FINE, n).otherwise(FINE + F.floor(F.log2(n / FINE) * BINS)).cast("long")
    found = sorted(counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect(), key=lambda r: -r["b"])
    least, rows = None, 0
    for r in found:
        rows += r["rows"]
        if rows > most:
            break
        least = r["least"]
    return [] if least is None else counts.where(n >= least).collect()
