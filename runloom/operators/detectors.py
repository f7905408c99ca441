"""Anomalies of each session as native windows: where they are raised, and their life cycles. The fold (operators.fold) also has their evidence and messages."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X
from runloom.operators.counters import usage_key
from runloom.operators.fold import Limits
from runloom.operators.ranges import range_of, running
from runloom.session import kept


def counted(events: DataFrame, size: int | None = None) -> DataFrame:
    """What the detectors read of events (sha256 only of calls) and, of the rows before each, the calls (call_no), the successes
    (run) and the user messages of the main thread (part); its time since the last one there (gap_us), and the cost so far with
    its own (micros). Rows that have been counted stay as they are."""
    if "call_no" in events.columns:
        return events
    # The first row of each key pays; rows without usage are no key, and lie apart so that they are not sorted as one.
    used = F.col("usage").isNotNull()
    nth = F.row_number().over(W.partitionBy("path", F.when(used, usage_key()), F.when(~used, F.col("seq"))).orderBy("seq"))
    paid = F.coalesce(F.when(used & (nth == 1), X.cost_micros()), F.lit(0).cast("decimal(38,4)"))
    read = F.struct("payload.tool_name", F.when(X.is_call(), F.col("payload.sha256")).alias("sha256"), "payload.is_error").alias("payload")
    rows = events.select("path", "seq", "kind", "source", "agent_id", "correlation_id", X.micros(F.col("ts")).alias("us"), read, paid.alias("paid"))
    succeeded = X.is_result() & ~X.failed()
    rows = running(
        rows, size,
        sums={"call_no": X.is_call().cast("int"), "run": succeeded.cast("int"), "before": F.col("paid"), "part": _said().cast("long")},
        lasts={"before_us": F.when(X.main_thread(), F.col("us"))},
    )
    so_far = {"gap_us": F.col("us") - F.col("before_us"), "micros": (F.col("before") + F.col("paid")).cast("decimal(38,4)")}
    return rows.withColumns(so_far).drop("us", "before_us", "before", "paid")


def _said() -> Column:
    return X.main_thread() & (F.col("kind") == "message") & (F.col("source") == "user")


def loop_hits(events: DataFrame, repeats: int = 4, window: int = 24) -> DataFrame:
    """Calls whose tool and input occur at least `repeats` times in the last `window` calls, with the number of hits."""
    calls = events.where(X.is_call()).select("path", "seq", X.tool("?").alias("tool_name"), F.coalesce("payload.sha256", F.lit("")).alias("sha256"))
    calls = calls.withColumn("call_no", F.row_number().over(W.partitionBy("path").orderBy("seq")))
    same = W.partitionBy("path", "tool_name", "sha256").orderBy("call_no").rangeBetween(1 - window, 0)
    hits = calls.withColumn("hits", F.count("*").over(same)).where(F.col("hits") >= repeats)
    return hits.withColumn("severity", F.when(F.col("hits") == repeats, "warn").otherwise("critical")).drop("sha256")


def error_streaks(events: DataFrame, streak: int = 3, size: int | None = None) -> DataFrame:
    """Each maximal run of at least `streak` failed results: where it was raised, its length and where a success cleared it."""
    # A success closes the run of failures before it, so both have one number.
    results = counted(events, size).where(X.is_result()).select("path", "seq", X.failed().alias("bad"), "run")
    rows = running(results, size, key=("path", "run"), sums={"n": F.col("bad").cast("int")})
    third = F.col("bad") & (F.col("n") == streak - 1)
    runs = rows.groupBy("path", "run").agg(F.min(F.when(third, F.col("seq"))).alias("detected_at_seq"), F.count_if("bad").alias("length"), F.max(F.when(~F.col("bad"), F.col("seq"))).alias("cleared_at_seq"))
    return runs.where(F.col("length") >= streak).select("path", "detected_at_seq", "length", "cleared_at_seq")


def tool_flood(events: DataFrame, cap: int = 100, caps: dict[str, int] | None = None, size: int | None = None) -> DataFrame:
    """Calls of a named tool from its cap on."""
    name = F.col("payload.tool_name")
    most = F.lit(cap)
    for tool, n in (caps or {}).items():
        most = F.when(name == tool, F.lit(n)).otherwise(most)
    calls = events.where(X.is_call() & (F.coalesce(name, F.lit("")) != "")).select("path", "seq", name.alias("tool_name"), most.alias("cap"))
    calls = running(calls, size, key=("path", "tool_name"), sums={"n": F.lit(1)}).withColumn("n", F.col("n") + 1)
    return calls.where("n >= cap").drop("cap")


def budget_crossings(events: DataFrame, warn_usd: float = 50.0, critical_usd: float = 200.0, size: int | None = None) -> DataFrame:
    """The first main-thread event of each session at which its cost so far reaches each limit."""
    rows = counted(events, size).where(X.main_thread()).select("path", "seq", "micros")
    reach = [F.struct(F.lit(name).alias("severity"), F.lit(round(usd * 1e6)).cast("decimal(38,4)").alias("limit")) for name, usd in (("warn", warn_usd), ("critical", critical_usd))]
    rows = rows.where(F.col("micros") >= F.least(*[r["limit"] for r in reach]))
    reached = rows.withColumn("of", F.explode(F.array(*reach))).where("micros >= of.limit")
    return reached.groupBy("path", F.col("of.severity").alias("severity")).agg(F.min("seq").alias("seq"), F.min_by("micros", "seq").alias("cost_micros"))


def stall_gaps(events: DataFrame, gap_s: float = 600.0, size: int | None = None) -> DataFrame:
    """Gaps of at least gap_s between timestamps of the main thread while a call was open, and the user messages before them.

    An id is open from a call to its next result or to the next user message, however often it is called: each row
    changes by one, or not at all, how many ids are open, and the changes add up within the part between user messages.
    """
    long = F.col("gap_us") >= int(gap_s * 1_000_000)
    # What is open after a row of an id follows from that row alone. Other rows lie apart, so that they are not sorted as one id.
    ident = F.coalesce("correlation_id", F.lit(""))
    opens = F.when((ident != "") & F.col("kind").isin("tool_call", "tool_result"), (F.col("kind") == "tool_call").cast("long"))
    rows = counted(events, size).where(X.main_thread()).select("path", "seq", "part", "gap_us", ident.alias("id"), opens.alias("opens"))
    rows = rows.where(F.col("opens").isNotNull() | long)
    of_id = W.partitionBy("path", "part", "id", F.when(F.col("opens").isNull(), F.col("seq"))).orderBy("seq")
    change = F.coalesce(F.col("opens") - F.lag("opens", 1, 0).over(of_id), F.lit(0))
    rows = running(rows.select("path", "seq", "part", "gap_us", change.alias("change")), size, key=("path", "part"), sums={"open_calls": F.col("change")})
    return rows.where(long & (F.col("open_calls") > 0)).select("path", "seq", "gap_us", "open_calls", "part")


def loops(events: DataFrame, repeats: int = 4, window: int = 24, clear_after: int = 6, size: int | None = None) -> DataFrame:
    """(path, severity, detected_at_seq, cleared_at_seq) of each loop.

    A hit begins a segment, up to the next hit. Of a segment's calls those that differ from its hit diverge, and the
    clear_after-th of them clears the loop; so a hit begins a new loop if the segment before it was cleared.
    """
    calls = counted(events, size).where(X.is_call()).select("path", "seq", X.tool("?").alias("tool"), F.coalesce("payload.sha256", F.lit("")).alias("sha256"), F.col("call_no").alias("no"))
    by = ["path", "tool", "sha256"]
    if size is not None:
        # Ranges of calls, each with those before it that its windows reach.
        wide = max(size, window)
        part = range_of("no", wide)
        calls = calls.withColumn("part", F.explode(F.array_compact(F.array(part, F.when(F.col("no") % wide > wide - window, part + 1)))))
        by = [*by, "part"]
    same = W.partitionBy(*by).orderBy("no").rangeBetween(1 - window, 0)
    calls = calls.withColumn("hits", F.count("*").over(same)).withColumn("hit", F.col("hits") >= repeats)
    if size is not None:
        calls = calls.where(range_of("no", wide) == F.col("part")).drop("part", "no")
    sign = F.struct("tool", "sha256")
    calls = running(calls, size, sums={"segment": F.col("hit").cast("long")}, lasts={"looping": F.when(F.col("hit"), sign)})
    calls = calls.withColumn("segment", F.col("segment") + F.col("hit").cast("long")).where("segment > 0")
    calls = calls.select("path", "segment", "seq", "hit", "hits", (~F.col("hit") & (sign != F.col("looping"))).alias("differs"))
    calls = running(calls, size, key=("path", "segment"), sums={"diverged": F.col("differs").cast("long")})
    cleared = F.col("differs") & (F.col("diverged") == clear_after - 1)
    ends = calls.groupBy("path", "segment").agg(F.min("seq").alias("seq"), F.max(F.when(F.col("hit"), F.col("hits"))).alias("hits"), F.min(F.when(cleared, F.col("seq"))).alias("cleared"))
    ends = running(ends, size, order="segment", sums={"loop": F.col("cleared").isNotNull().cast("long")})
    severity = F.when(F.max_by("hits", "segment") > repeats, "critical").otherwise("warn")
    return ends.groupBy("path", "loop").agg(severity.alias("severity"), F.min("seq").alias("detected_at_seq"), F.max("cleared").alias("cleared_at_seq")).drop("loop")


def stalls(events: DataFrame, gap_s: float = 600.0, size: int | None = None) -> DataFrame:
    """(path, severity, detected_at_seq, cleared_at_seq) of each stall: from the first gap between two user messages to the latter of them."""
    rows = counted(events, size)
    gaps = stall_gaps(rows, gap_s, size).groupBy("path", "part").agg(F.min("seq").alias("detected_at_seq"))
    ends = rows.where(_said()).select("path", "part", F.col("seq").alias("cleared_at_seq"))
    return gaps.join(ends, ["path", "part"], "left").select("path", F.lit("warn").alias("severity"), "detected_at_seq", "cleared_at_seq")


def life_cycles(events: DataFrame, limits: Limits | None = None, size: int | None = None) -> DataFrame:
    """(path, kind, severity, detected_at_seq, cleared_at_seq) of every anomaly: the intervals of the fold, as native plans.

    Severity is that of the last time it was raised. Floods and budgets are never cleared. With a size, sessions are cut
    into ranges of so many places (see ranges).
    """
    at = limits or Limits()
    events = counted(events, size)
    if size is not None:
        events = kept(events, "counted")
    never = F.lit(None).cast("long")
    streaks = error_streaks(events, at.streak, size).select("path", F.lit("critical").alias("severity"), "detected_at_seq", "cleared_at_seq")
    floods = tool_flood(events, at.flood_cap, at.flood_caps, size).groupBy("path").agg(F.min("seq").alias("detected_at_seq")).select("path", F.lit("warn").alias("severity"), "detected_at_seq", never.alias("cleared_at_seq"))
    crossed = budget_crossings(events, at.warn_usd, at.critical_usd, size).groupBy("path").agg(F.min("seq").alias("detected_at_seq"), F.min("severity").alias("severity"))
    budgets = crossed.select("path", "severity", "detected_at_seq", never.alias("cleared_at_seq"))
    kinds = {"loop": loops(events, at.loop_repeats, at.loop_window, at.loop_clear_after, size), "error_streak": streaks, "tool_flood": floods, "budget": budgets, "stall": stalls(events, at.stall_s, size)}
    parts = [rows.select("path", F.lit(kind).alias("kind"), "severity", "detected_at_seq", "cleared_at_seq") for kind, rows in kinds.items()]
    return functools.reduce(DataFrame.unionByName, parts)
