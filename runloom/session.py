"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "runloom", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting, Arrow; conf adds to or overrides these."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of the session (spark.checkpoint.dir).

    Where none is set, in a temporary one; on a cluster, whose hosts could not read that, this is an error.
    """
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        shared = "file://" + tempfile.mkdtemp(prefix="runloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to a scratch table, for what several parts of a plan read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to a Python worker at once where rows are large, as states and pages of sessions are.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are bounded; the setting stays, and results do not depend on it."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
