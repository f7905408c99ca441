"""Canonical events from relational tables. Every session is a path; seq counts from 0 within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions.expressions import payload
from runloom.schema import EVENTS, SCHEMA_VERSION


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(df: DataFrame, *more: str) -> DataFrame:
    """df in the columns and types of the events schema, and `more` columns; what it lacks is null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS.fields], *more)


def _raw(path, line) -> F.Column:
    return F.struct(path.alias("path"), line.cast("long").alias("line_no"), F.lit(0).cast("long").alias("byte_offset"), F.lit(0).alias("block_index"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each user of `events`: signups are turns, views and clicks calls, purchases and errors results."""
    rows = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    cents = F.round(F.col("value") * 100).cast("long")
    kind = F.when(F.col("event_type") == "signup", "message").when(F.col("event_type").isin("view", "click"), "tool_call").otherwise("tool_result")
    rows = rows.select(
        F.col("user_id").cast("string").alias("path"),
        F.struct("ts", "event_id").alias("place"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        "event_type",
        k.alias("k"),
        cents.alias("cents"),
        F.when(F.col("event_id") % 11 == 0, F.lit("sidechain")).alias("agent_id"),
    )
    # Both windows have one order, so the sessions are dealt and sorted once.
    order = W.partitionBy("path").orderBy("place")
    rows, before = rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")), order.rowsBetween(W.unboundedPreceding, -1)
    call = (F.col("kind") == "tool_call") & F.col("agent_id").isNull()
    latest = F.last(F.when(call, F.col("seq")), ignorenulls=True).over(before)
    is_result = F.col("kind") == "tool_result"
    body = F.when(F.col("kind") == "tool_call", F.concat(F.lit('{"k": '), F.pmod("k", F.lit(5)), F.lit("}")))
    body = body.when(is_result, F.concat(F.lit("cents = "), F.col("cents"), F.lit("\nkk = "), F.col("k"))).otherwise(F.col("event_type"))
    model = F.when(F.pmod("k", F.lit(3)) == 0, "test-premium").when(F.pmod("k", F.lit(3)) == 1, "plain")
    usage = F.struct(model.alias("model"), F.col("k").alias("input_tokens"), F.col("cents").alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"))
    return canonical(
        rows.select(
            "path", "seq", "event_id", F.col("event_id").alias("record_id"), "ts", "kind", "agent_id",
            F.when(F.col("kind") == "message", "user").when(is_result, "tool").otherwise("agent").alias("source"),
            F.col("path").alias("session_id"),
            F.when(F.col("agent_id").isNull(), F.when(call, F.col("seq")).when(is_result, latest)).cast("string").alias("correlation_id"),
            F.concat(F.lit("m"), F.floor(F.col("seq") / 2)).alias("api_message_id"),
            payload(body, F.when(F.col("kind") == "tool_call", F.col("event_type")), F.col("event_type") == "error").alias("payload"),
            F.when(F.col("kind") == "tool_call", usage).alias("usage"),
            _raw(F.col("path"), F.col("seq") + 1).alias("raw"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
        )
    )


def conversation_events(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """A session for each conversation; system rows are metadata. With `whole`, whole_text has the text that the payload caps."""
    rows = table(spark, sf_dir, "conversations")
    role = F.col("role")
    return canonical(
        rows.select(
            F.col("conv_id").cast("string").alias("path"),
            F.col("turn").cast("long").alias("seq"),
            F.concat_ws(":", "conv_id", "turn").alias("event_id"),
            F.concat_ws(":", "conv_id", "turn").alias("record_id"),
            F.when(role == "user", "user").when(role == "assistant", "agent").otherwise("meta").alias("source"),
            F.when(role.isin("user", "assistant"), "message").otherwise("session_meta").alias("kind"),
            F.col("conv_id").cast("string").alias("session_id"),
            payload(F.col("text")).alias("payload"),
            _raw(F.col("conv_id").cast("string"), F.col("turn") + 1).alias("raw"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
            F.col("text").alias("whole_text"),
        ),
        *["whole_text"] * whole,
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each customer: an order is a call at its date, its line items are results at their ship dates."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    owner = orders.select("o_orderkey", "o_custkey")
    calls = orders.select("o_custkey", F.col("o_orderdate").alias("ts"), F.lit(0).alias("after"), F.col("o_orderkey").alias("key"), F.lit(0).alias("line"))
    results = items.join(owner, items["l_orderkey"] == owner["o_orderkey"]).select("o_custkey", F.col("l_shipdate").alias("ts"), F.lit(1).alias("after"), F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"))
    order = W.partitionBy("o_custkey").orderBy("ts", "after", "key", "line")
    rows = calls.unionByName(results).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    call = F.col("after") == 0
    return canonical(
        rows.select(
            F.col("o_custkey").cast("string").alias("path"), "seq",
            F.concat_ws("-", "key", "line").alias("event_id"), F.concat_ws("-", "key", "line").alias("record_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.when(call, "agent").otherwise("tool").alias("source"),
            F.when(call, "tool_call").otherwise("tool_result").alias("kind"),
            F.col("o_custkey").cast("string").alias("session_id"),
            F.col("key").cast("string").alias("correlation_id"),
            payload(F.lit(""), F.when(call, F.lit("order"))).alias("payload"),
            _raw(F.col("o_custkey").cast("string"), F.col("seq") + 1).alias("raw"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
        )
    )
