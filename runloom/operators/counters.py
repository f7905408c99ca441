"""Counters, usage and position of each session, as native aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X

MAX_RECENT_FAILURES = 8


def session_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("path").agg(
        F.count("*").alias("n_events"),
        F.count_if(~X.main_thread()).alias("sidechain_events"),
        F.count_if(X.is_turn()).alias("n_turns"),
        F.count_if(X.is_call()).alias("n_tool_calls"),
        F.count_if(X.is_result() & X.failed()).alias("n_tool_errors"),
    )


def per_tool(events: DataFrame) -> DataFrame:
    return events.where(X.is_call()).groupBy("path", X.tool().alias("tool_name")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def top_tools(events: DataFrame, most: int = 8) -> DataFrame:
    """The tools called most, ties by first appearance."""
    order = W.partitionBy("path").orderBy(F.desc("n"), "first_seq")
    return per_tool(events).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("path", "rank", "tool_name", "n")


def usage_key() -> F.Column:
    """What usage is counted once for: the API message, or the record where none is named."""
    return F.coalesce(F.nullif("api_message_id", F.lit("")), F.concat(F.lit("rec:"), F.col("record_id")))


def first_usage(events: DataFrame) -> DataFrame:
    """The first event with usage of each API message, side chains included; others of a message do not count."""
    rows = events.where("usage is not null").withColumn("usage_key", usage_key())
    first = W.partitionBy("path", "usage_key").orderBy("seq")
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def usage_totals(events: DataFrame) -> DataFrame:
    """Tokens and exact micro-dollars of each session that has any usage."""
    sums = [F.sum(F.coalesce(F.col(f"usage.{c}"), F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    out = first_usage(events).groupBy("path").agg(F.count("*").alias("n_messages"), *sums, F.sum(X.cost_micros()).alias("cost_micros"))
    return out.withColumn("cost_usd", X.dollars(F.col("cost_micros")))


def models_seen(events: DataFrame) -> DataFrame:
    rows = first_usage(events).where(F.coalesce(F.col("usage.model"), F.lit("")) != "")
    return rows.groupBy("path", F.col("usage.model").alias("model")).agg(F.count("*").alias("n"))


def session_clock(events: DataFrame) -> DataFrame:
    """First and last non-null timestamps in order of seq (not the least and greatest), in microseconds."""
    timed = F.col("ts").isNotNull()
    ts = X.micros(F.col("ts"))
    start = F.min_by(F.when(timed, ts), F.when(timed, F.col("seq")))
    last = F.max_by(F.when(timed, ts), F.when(timed, F.col("seq")))
    out = events.groupBy("path").agg(start.alias("started_us"), last.alias("last_us"))
    return out.withColumn("wall_us", F.col("last_us") - F.col("started_us"))


def position(events: DataFrame) -> DataFrame:
    """Goal, latest request, last agent text, frontier and displayed session id of each session."""
    seq = F.col("seq")
    said = X.strip(X.text())
    spoke = X.main_thread() & (F.col("kind") == "message") & (F.col("source") == "agent") & (said != "")
    does = F.concat(F.lit("calling "), X.tool(), F.lit("("), arg_hint(), F.lit(")"))
    now = F.when(spoke, F.concat(F.lit("said: "), F.substring(said, 1, 160))).when(X.is_call(), does)
    known = F.col("session_id") != "unknown"

    def at(value, when, pick):
        return pick(F.when(when, value), F.when(when, seq))

    return events.groupBy("path").agg(
        F.coalesce(at(F.col("session_id"), known, F.max_by), F.lit("unknown")).alias("session_id"),
        at(F.substring(said, 1, 1000), X.is_turn(), F.min_by).alias("goal_text"),
        at(F.substring(said, 1, 500), X.is_turn(), F.max_by).alias("latest_user_directive"),
        at(F.substring(said, 1, 500), spoke, F.max_by).alias("last_agent_text"),
        at(now, now.isNotNull(), F.max_by).alias("frontier"),
    )


def arg_hint() -> F.Column:
    """`key=value` of the first argument of a call, the value cut to 60; empty if the input is no JSON object or was cut.

    Text values come out bare; other values keep their JSON spelling.
    """
    args = F.from_json(F.when(X.text().startswith("{"), X.text()), "map<string,string>")
    key = F.get(F.map_keys(args), F.lit(0))
    return F.coalesce(F.when(F.size(args) > 0, F.concat(key, F.lit("="), F.substring(F.coalesce(F.try_element_at(args, key), F.lit("None")), 1, 60))), F.lit(""))


def files_touched(events: DataFrame) -> DataFrame:
    named = events.select("path", "seq", X.file_path().alias("file")).where("file is not null")
    return named.groupBy("path", "file").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def failures(events: DataFrame) -> DataFrame:
    """Failed results, after the name of the tool they answer, and API errors of the main thread."""
    from runloom.operators.correlation import with_calls

    rows = with_calls(events.where(X.main_thread() & F.col("kind").isin("tool_call", "tool_result", "error")))
    bad = (F.col("kind") == "error") | ((F.col("kind") == "tool_result") & X.failed())
    who = F.when(F.col("kind") == "error", F.lit("api")).otherwise(F.coalesce("call.tool_name", F.lit("?")))
    return rows.where(bad).select("path", "seq", F.concat(who, F.lit(": "), F.substring(X.text(), 1, 160)).alias("failure"))


def recent_failures(events: DataFrame, most: int = MAX_RECENT_FAILURES) -> DataFrame:
    """The last failures of each session; rank 1 is the latest."""
    order = W.partitionBy("path").orderBy(F.desc("seq"))
    return failures(events).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def event_by_id(events: DataFrame, event_id: str) -> DataFrame:
    """The last event of each session with an id."""
    return events.where(F.col("event_id") == event_id).groupBy("path").agg(F.max_by(F.struct(*events.columns), "seq").alias("e")).select("e.*")


def children_of(events: DataFrame, record_id: str) -> DataFrame:
    return events.where(F.col("parent_event_id") == record_id)
