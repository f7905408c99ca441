"""Facts: `key = value` lines of successful results, with the source that the answered call names.

A key with several values has versions K, K#2, K#3, ... in order of first
appearance. Native as long as no session has more than MAX_FACTS of them; the
fold (operators.fold) evicts beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X
from runloom.operators.correlation import with_calls

MAX_FACTS = 120
MAX_LINES = 200
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def fact_lines(events: DataFrame) -> DataFrame:
    """(path, seq, line_no, source, key, value) in order of appearance."""
    rows = with_calls(events.where(F.col("kind").isin("tool_call", "tool_result")))
    rows = rows.where((F.col("kind") == "tool_result") & ~X.failed() & (X.text() != ""))
    source = F.nullif(F.regexp_extract(F.coalesce("call.input", F.lit("")), X.PATH_ARGUMENT, 1), F.lit(""))
    lines = rows.select("path", "seq", source.alias("source"), F.posexplode(F.slice(F.split(X.text(), LINE_END), 1, MAX_LINES)).alias("line_no", "line"))
    found = lines.where(F.col("line").rlike(X.FACT_LINE)).select("path", "seq", "line_no", "source", F.regexp_extract("line", X.FACT_LINE, 1).alias("key"), F.regexp_extract("line", X.FACT_LINE, 2).alias("value"))
    return found.where("key <> 'retries'")


def fact_versions(events: DataFrame) -> DataFrame:
    """(path, key, base, value, nth): distinct values of each scoped key; nth counts the session's facts by first appearance."""
    rows = fact_lines(events).withColumn("scoped", F.concat(F.coalesce(F.concat("source", F.lit(":")), F.lit("")), F.col("key")))
    first = rows.groupBy("path", "scoped", "value").agg(F.min(F.struct("seq", "line_no")).alias("at"))
    version = F.row_number().over(W.partitionBy("path", "scoped").orderBy("at"))
    nth = F.row_number().over(W.partitionBy("path").orderBy("at", "scoped", "value"))
    named = first.withColumn("version", version).withColumn("nth", nth)
    key = F.when(F.col("version") == 1, F.col("scoped")).otherwise(F.concat("scoped", F.lit("#"), "version"))
    return named.select("path", key.alias("key"), X.base_key(key).alias("base"), "value", "nth")


def group_sums(facts: DataFrame, least: int = 3) -> DataFrame:
    """Count, sum and last key of each base key all of whose values are whole numbers, if there are at least so many."""
    number = X.whole_number(F.col("value"))
    sums = facts.groupBy("path", "base").agg(F.count("*").alias("n"), F.sum(number).alias("total"), F.bool_and(number.isNotNull()).alias("whole"), F.max_by("key", "nth").alias("through"))
    return sums.where((F.col("whole")) & (F.col("n") >= least)).drop("whole")
