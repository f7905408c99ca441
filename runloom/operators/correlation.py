"""Calls and their results: a result belongs to the latest earlier call of its id.

A call without an id, or whose id an earlier call already holds, is a call of its
own; the first result after a call closes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X

HAS_ID = "coalesce(correlation_id, '') <> ''"


def with_calls(events: DataFrame) -> DataFrame:
    """Main-thread events with the call (call_seq, call_ts, tool_name, input) that each result answers, null for others."""
    # Rows without an id lie apart, so that they are not sorted as one.
    known = F.expr(HAS_ID)
    before = W.partitionBy("path", "correlation_id", F.when(~known, F.col("seq"))).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    here = F.struct(F.col("seq").alias("call_seq"), F.col("ts").alias("call_ts"), X.tool().alias("tool_name"), F.substring(X.text(), 1, 200).alias("input"))
    latest = F.last(F.when((F.col("kind") == "tool_call") & known, here), ignorenulls=True).over(before)
    return events.where(X.main_thread()).withColumn("call", F.when((F.col("kind") == "tool_result") & known, latest))


def _linked(events: DataFrame) -> DataFrame:
    return with_calls(events.where(F.col("kind").isin("tool_call", "tool_result")))


def call_result_pairs(events: DataFrame) -> DataFrame:
    """(path, correlation_id, call_seq, result_seq, duration_us, result_failed) of every closed call."""
    results = _linked(events).where("call is not null")
    span = F.greatest(X.micros(F.col("ts")) - X.micros(F.col("call.call_ts")), F.lit(0).cast("long"))
    span = F.when(F.col("ts").isNotNull() & F.col("call.call_ts").isNotNull(), span)
    first = results.groupBy("path", "correlation_id", F.col("call.call_seq").alias("call_seq")).agg(
        F.min("seq").alias("result_seq"), F.min_by(span, "seq").alias("duration_us"), F.max(X.failed()).alias("result_failed")
    )
    return first


def pending_calls(events: DataFrame) -> DataFrame:
    """(path, correlation_id, call_seq, first_seq) of ids whose last call has no later result, in order of first_seq."""
    rows = events.where(X.main_thread() & F.expr(HAS_ID) & F.col("kind").isin("tool_call", "tool_result"))
    call = F.when(F.col("kind") == "tool_call", F.col("seq"))
    result = F.when(F.col("kind") == "tool_result", F.col("seq"))
    ids = rows.groupBy("path", "correlation_id").agg(F.max(call).alias("call_seq"), F.min(call).alias("first_seq"), F.max(result).alias("result_seq"))
    return ids.where("call_seq > coalesce(result_seq, -1)").drop("result_seq")


def orphan_results(events: DataFrame) -> DataFrame:
    """Results of the main thread that answer no earlier call."""
    return _linked(events).where((F.col("kind") == "tool_result") & F.col("call").isNull()).select("path", "seq", "correlation_id")


def repeated_results(events: DataFrame) -> DataFrame:
    """Results that come after the first of their call."""
    results = _linked(events).where("call is not null").select("path", "seq", "correlation_id", F.col("call.call_seq").alias("call_seq"))
    order = W.partitionBy("path", "correlation_id", "call_seq").orderBy("seq")
    return results.withColumn("nth", F.row_number().over(order)).where("nth > 1")


def unanswered_ids(events: DataFrame) -> DataFrame:
    """Ids that were called but have no result at all (calls EXCEPT results)."""
    main = events.where(X.main_thread() & F.expr(HAS_ID))
    called = main.where("kind = 'tool_call'").select("path", "correlation_id")
    return called.subtract(main.where("kind = 'tool_result'").select("path", "correlation_id"))
