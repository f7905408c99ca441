"""Episodes: a turn of the main thread and what follows until the next one, with later results put back where they belong.

Exact where no session gives one id to two calls; otherwise use the fold (operators.fold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X
from runloom.operators.correlation import HAS_ID, with_calls

FLUSH_EVERY = 20


def with_episodes(events: DataFrame) -> DataFrame:
    """Main-thread events with episode (0 before the first turn), and late_for: the earlier episode whose open call a result answers."""
    order = W.partitionBy("path").orderBy("seq")
    rows = with_calls(events).withColumn("is_turn", X.is_turn())
    rows = rows.withColumn("episode", F.sum(F.col("is_turn").cast("int")).over(order))
    known = F.expr(HAS_ID)
    of_id = W.partitionBy("path", "correlation_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    call_episode = F.last(F.when((F.col("kind") == "tool_call") & known, F.col("episode")), ignorenulls=True).over(of_id)
    nth = W.partitionBy("path", "correlation_id", "call.call_seq").orderBy("seq")
    first = F.row_number().over(nth) == 1
    late = (F.col("kind") == "tool_result") & F.col("call").isNotNull() & first & (F.col("call_episode") > 0) & (F.col("call_episode") < F.col("episode"))
    return rows.withColumn("call_episode", call_episode).withColumn("late_for", F.when(late, F.col("call_episode")))


def late_results(events: DataFrame) -> DataFrame:
    rows = with_episodes(events).where("late_for is not null")
    return rows.select("path", "seq", "correlation_id", "episode", "late_for", X.failed().alias("failed"))


def open_at_close(events: DataFrame) -> DataFrame:
    """(path, episode, correlation_id, tool_name, answered): calls without a result in their own episode, and whether one came later."""
    rows = with_episodes(events).where((F.col("episode") > 0) & F.expr(HAS_ID))
    calls = rows.where("kind = 'tool_call'").groupBy("path", "episode", "correlation_id").agg(F.max("seq").alias("call_seq"), F.max_by(X.tool("?"), "seq").alias("tool_name"))
    results = rows.where("kind = 'tool_result'").groupBy("path", "correlation_id").agg(F.max("seq").alias("last_seq"), F.collect_set("episode").alias("in_episodes"))
    both = calls.join(results, ["path", "correlation_id"], "left")
    inside = F.coalesce(F.array_contains("in_episodes", F.col("episode")), F.lit(False))
    return both.where(~inside).select("path", "episode", "correlation_id", "tool_name", F.coalesce(F.col("last_seq") > F.col("call_seq"), F.lit(False)).alias("answered"))


def episodes(events: DataFrame) -> DataFrame:
    """One row per episode: digest, status, dangling tools and number of versions."""
    rows = with_episodes(events).where("episode > 0")
    fed = ~F.col("is_turn") & F.col("late_for").isNull()
    bad = (F.col("kind") == "error") | ((F.col("kind") == "tool_result") & X.failed())
    said = X.strip(X.text())
    spoke = fed & (F.col("kind") == "message") & (F.col("source") == "agent") & (said != "")
    call = fed & (F.col("kind") == "tool_call")
    own = F.col("is_turn") | fed
    us = X.micros(F.col("ts"))
    timed = own & F.col("ts").isNotNull()
    digest = rows.groupBy("path", "episode").agg(
        F.min(F.when(F.col("is_turn"), F.col("seq"))).alias("covered_lo"),
        F.max(F.when(own, F.col("seq"))).alias("covered_hi"),
        F.max(F.when(F.col("is_turn"), F.substring(said, 1, 200))).alias("ask"),
        F.count_if(call).alias("n_calls"),
        F.count_if(fed & bad).alias("own_errors"),
        F.count_if(fed).alias("fed"),
        F.max_by(F.when(spoke, F.substring(said, 1, 240)), F.when(spoke, F.col("seq"))).alias("conclusion"),
        F.max(F.when(F.col("is_turn"), us)).alias("t0"),
        F.max_by(F.when(timed, us), F.when(timed, F.col("seq"))).alias("t1"),
        F.array_sort(F.slice(F.sort_array(F.collect_list(F.when(fed & bad, F.col("seq"))), False), 1, 12)).alias("own_pins"),
    )
    tools = rows.where(call).groupBy("path", "episode", X.tool("?").alias("tool")).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tool", "n"))), lambda t: F.concat(t["tool"], F.lit("×"), t["n"])), ", ")
    tools = tools.groupBy("path", "episode").agg(listed.alias("tools"))
    late = rows.where("late_for is not null").groupBy("path", F.col("late_for").alias("episode")).agg(F.count("*").alias("n_late"), F.count_if(X.failed()).alias("late_errors"))
    dangling = open_at_close(events).groupBy("path", "episode").agg(F.count("*").alias("n_dangling"), F.count_if(~F.col("answered")).alias("n_unanswered"), F.array_join(F.sort_array(F.collect_set("tool_name")), ",").alias("dangling_tools"))
    last = W.partitionBy("path")
    out = digest.withColumn("is_last", F.col("episode") == F.max("episode").over(last))
    for part in (tools, late, dangling):
        out = out.join(part, ["path", "episode"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("n_late", "late_errors", "n_dangling", "n_unanswered")})
    errors = F.col("own_errors") + F.col("late_errors")
    settled = F.when(errors > 0, "errors").otherwise("ok")
    status = F.when(F.col("n_unanswered") > 0, F.when(F.col("is_last"), "unresolved").otherwise("interrupted")).otherwise(settled)
    versions = 2 + F.floor(F.col("fed") / FLUSH_EVERY) + F.when(F.col("n_dangling") > 0, 1).otherwise(0) + F.col("n_late")
    return out.select(
        "path", "episode", F.format_string("ep-%04d", F.col("episode").cast("int")).alias("node_id"), "covered_lo", "covered_hi", "ask", "n_calls",
        errors.alias("errors"), status.alias("status"), F.coalesce("tools", F.lit("no tools")).alias("tools"), "conclusion",
        (F.col("t1") - F.col("t0")).alias("duration_us"), F.coalesce("dangling_tools", F.lit("")).alias("dangling_tools"),
        versions.cast("long").alias("n_versions"), F.array_join(F.col("own_pins").cast("array<string>"), ",").alias("pins"),
    )
