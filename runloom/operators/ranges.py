"""Sessions cut into ranges: running values of a session's rows that no task has to read from its beginning.

A range is `size` consecutive places of a session. What it adds to a running value (a
sum, the last known value) is a summary, and summaries of ranges that follow each other
merge to one of the whole, so a session may be cut anywhere. Here one row a range meets
in a window (for ten million rows some hundred), and each range goes on from what the
ones before add up to. So rows are shuffled by session and range, and a session as
long as all others together is spread over as many tasks as it has ranges.

`state` puts the run state of the fold together in this way: groupings by key, and
running values in ranges; no stage reads a session in one task. Facts beyond the fold's
cap are the exception (what is evicted depends on what is live): `state` refuses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X
from runloom.session import kept

#: Places of a range.
SIZE = 1 << 16


def range_of(order: str, size: int) -> Column:
    return F.expr(f"CAST({order} AS BIGINT) DIV {size}")


def running(rows: DataFrame, size: int | None = None, key: tuple[str, ...] = ("path",), order: str = "seq", sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with a column for each of `sums` (0 at first) and each of `lasts` (the last value that is not null) over the rows before.

    Rows are in order of a whole number, different within a key. Without a size, each key is one window. With one, rows are
    read twice (for the ranges' sums, and to go on from them), so they are written to a scratch table first: running values
    of running values would else compute the rows below them twice for each.
    """
    sums, lasts = sums or {}, lasts or {}
    values = {f"_v_{n}": c for n, c in (sums | lasts).items()}
    if size is None:
        before = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        done = {n: F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) for n in sums} | {n: F.last(f"_v_{n}", ignorenulls=True).over(before) for n in lasts}
        return rows.withColumns(values).withColumns(done).drop(*values)
    valued = kept(rows, "ranges").withColumns(values | {"_range": range_of(order, size), "_own": F.lit(True)})
    known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))
    own = valued.groupBy(*key, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_o_{n}") for n in sums], *[F.max_by(f"_v_{n}", known(n)).alias(f"_o_{n}") for n in lasts])
    ahead = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    carried = own.select(
        *key, "_range", F.lit(False).alias("_own"),
        *[F.sum(f"_o_{n}").over(ahead).alias(f"_v_{n}") for n in sums], *[F.last(f"_o_{n}", ignorenulls=True).over(ahead).alias(f"_v_{n}") for n in lasts],
    )
    # What is carried into a range is a row before its rows, so that these are shuffled and sorted once.
    within = W.partitionBy(*key, "_range").orderBy("_own", order).rowsBetween(W.unboundedPreceding, -1)
    done = {n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in sums} | {n: F.last(f"_v_{n}", ignorenulls=True).over(within) for n in lasts}
    return valued.unionByName(carried, allowMissingColumns=True).withColumns(done).where("_own").drop("_own", "_range", *values)


def latest(rows: DataFrame, most: int, size: int | None = None, key: str = "path", order: str = "seq") -> DataFrame:
    """The last `most` rows of each key, with rank 1 for the last."""
    rank = lambda *by: F.row_number().over(W.partitionBy(key, *by).orderBy(F.desc(order)))
    if size is not None:
        rows = rows.withColumn("_range", range_of(order, size)).withColumn("rank", rank("_range")).where(F.col("rank") <= most).drop("rank", "_range")
    return rows.withColumn("rank", rank()).where(F.col("rank") <= most)


def fact_versions(events: DataFrame, size: int | None = SIZE) -> DataFrame:
    """facts.fact_versions (path, key, base, value, nth), the facts of a session numbered in ranges of their places."""
    from runloom.operators import facts

    lines = facts.fact_lines(events).withColumn("scoped", F.concat(F.coalesce(F.concat("source", F.lit(":")), F.lit("")), F.col("key")))
    at = F.col("seq") * facts.MAX_LINES + F.col("line_no")
    first = lines.groupBy("path", "scoped", "value").agg(F.min(at).alias("at"))
    wide = size and size * facts.MAX_LINES
    named = running(running(first, wide, key=("path", "scoped"), order="at", sums={"version": F.lit(1)}), wide, order="at", sums={"nth": F.lit(1)})
    key = F.when(F.col("version") == 0, F.col("scoped")).otherwise(F.concat("scoped", F.lit("#"), (F.col("version") + 1).cast("string")))
    return named.select("path", key.alias("key"), X.base_key(key).alias("base"), "value", (F.col("nth") + 1).alias("nth"))


def state(events: DataFrame, limits=None, size: int = SIZE) -> DataFrame:
    """The fields of the fold's STATE that a session's events alone decide, each as the fold has it: all but the messages and
    evidence of anomalies and the episodes. Lists that grow with a session (tools, files, pending calls, anomalies) are one value each.

    A session with more facts than limits.max_facts is an error.
    """
    from runloom.operators import correlation, counters, detectors
    from runloom.operators.fold import Limits

    limits = limits or Limits()
    listed = lambda place, **fields: F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("x")))), lambda r: r["x"])
    base = counters.session_counters(events).join(events.groupBy("path").agg(F.max("seq").alias("observed_seq")), "path")
    usage = counters.usage_totals(events).select("path", F.array("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens").alias("tokens"), "cost_usd")
    models = counters.first_usage(events).where("coalesce(usage.model, '') <> ''").groupBy("path", F.col("usage.model").alias("model")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    facts = fact_versions(events, size)
    over = F.when(F.max("nth") > limits.max_facts, F.raise_error(F.concat(F.lit("more facts than the cap in "), F.col("path"))))
    lives = detectors.life_cycles(events, limits, size)
    parts = [
        base, counters.position(events), counters.session_clock(events).drop("wall_us"), usage,
        models.groupBy("path").agg(listed("first", name="model", n="n").alias("models")),
        counters.per_tool(events).groupBy("path").agg(listed("first_seq", name="tool_name", n="n").alias("tools")),
        counters.files_touched(events).groupBy("path").agg(listed("first_seq", name="file", n="n").alias("files")),
        correlation.pending_calls(events).groupBy("path").agg(listed("first_seq", correlation_id="correlation_id", call_seq="call_seq").alias("pending")),
        latest(counters.failures(events), counters.MAX_RECENT_FAILURES, size).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "failure"))), lambda r: r["failure"]).alias("recent_failures")),
        facts.groupBy("path").agg(F.coalesce(over.cast("array<struct<key:string,value:string>>"), listed("nth", key="key", value="value")).alias("facts")),
        lives.groupBy("path").agg(listed("detected_at_seq", kind="kind", severity="severity", detected_at_seq="detected_at_seq", cleared_at_seq="cleared_at_seq").alias("anomalies")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "path", "left")
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("models", "tools", "files", "pending", "recent_failures", "facts", "anomalies")}
    return out.withColumns(empty | {"tokens": F.coalesce("tokens", zero), "cost_usd": F.coalesce("cost_usd", F.lit(0.0))})
