"""What a worker is shown and how its run is judged: masked and retrieved context, searches, running totals, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X
from runloom.operators import ranges


def flat_log(events: DataFrame) -> DataFrame:
    """One line for each main-thread event."""
    body = F.replace(F.substring(X.text(), 1, 200), F.lit("\n"), F.lit(" "))
    line = F.format_string("[%d] %s/%s %s %s", "seq", "source", "kind", F.coalesce("payload.tool_name", F.lit("")), body)
    return events.where(X.main_thread()).select("path", "seq", line.alias("line"))


def tail_chars(text: F.Column, n: int = 100_000) -> F.Column:
    return F.right(text, F.lit(n))


def tail(rows: DataFrame, order: str, text: str, most: int = 100_000, size: int | None = ranges.SIZE) -> DataFrame:
    """(path, context): the last `most` characters of each path's texts, in order and joined by line feeds.

    Sums of lengths, run in ranges, tell which texts the tail reaches; only these, the first of them cut, meet in one row,
    so no value has more than `most` characters. A null text counts as empty.
    """
    rows = rows.select("path", F.col(order).alias("_at"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_n", F.length("_text") + 1)
    whole = rows.groupBy("path").agg(F.sum("_n").alias("_all"))
    rows = ranges.running(rows, size, order="_at", sums={"_before": F.col("_n")}).join(whole, "path")
    after = F.col("_all") - F.col("_before") - F.col("_n")  # characters behind a text, the line feed before them included
    reached = rows.withColumn("_left", F.lit(most) - after).where("_left > 0").select("path", "_at", "_before", F.right("_text", F.col("_left").cast("int")).alias("_text"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), "\n")
    earlier = F.when(F.min("_before") > 0, F.lit("\n")).otherwise(F.lit(""))  # the line feed before the first, where a text is before it
    return reached.groupBy("path").agg(F.right(F.concat(earlier, parts), F.lit(most)).alias("context"))


def masked_context(events: DataFrame, keep: int = 3, stub: str = "[omitted]") -> DataFrame:
    """All events, the texts of all but the last `keep` of each session replaced by a stub."""
    back = F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))
    shown = F.when(F.col("back") <= keep, X.whole_text(events)).otherwise(F.lit(stub))
    return events.withColumn("back", back).select("path", "seq", shown.alias("shown"))


def turn_rows(events: DataFrame) -> DataFrame:
    """(path, nth, role, content) of the messages, which a longer session only extends."""
    rows = events.where(X.main_thread() & (F.col("kind") == "message"))
    nth = F.row_number().over(W.partitionBy("path").orderBy("seq"))
    return rows.select("path", nth.alias("nth"), F.when(F.col("source") == "user", "user").otherwise("assistant").alias("role"), X.whole_text(events).alias("content"))


def tokens(text: F.Column, breaks: str = r"[^\p{L}\p{N}_]+") -> F.Column:
    """Distinct words of over two characters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), breaks), lambda w: F.length(w) > 2))


def retrieve(events: DataFrame, most: int = 10, recent: int = 1, older: int | None = None, ends: int | None = None, breaks: str = r"[^\p{L}\p{N}_]+") -> DataFrame:
    """Of each session's earlier messages, the `most` nearest to its last `recent` by shared words over the root of their number.

    Whole texts count; to score what a worker is shown, `older` takes the first characters of earlier messages and `ends`
    the last ones of the recent. rank is by score, then seq; shown in order of seq they are as a worker sees them.
    """
    text = X.whole_text(events)
    rows = events.where(X.main_thread() & (F.col("kind") == "message")).select("path", "seq", text.alias("text"))
    rows = rows.withColumn("back", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq"))))
    end = F.when(F.col("back") <= recent, F.struct("seq", (F.right("text", F.lit(ends)) if ends else F.col("text")).alias("t")))
    asked = F.array_join(F.transform(F.array_sort(F.collect_list(end).over(W.partitionBy("path"))), lambda x: x["t"]), " ")
    words = tokens(F.substring("text", 1, older) if older else F.col("text"), breaks)
    rows = rows.withColumn("query", tokens(asked, breaks)).withColumn("words", words).where(F.col("back") > recent)
    shared = F.size(F.array_intersect("query", "words"))
    rows = rows.withColumn("score", shared / F.sqrt(1 + F.size("words"))).where("score > 0")
    best = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "seq"))
    return rows.withColumn("rank", best).where(F.col("rank") <= most).select("path", "seq", "rank", "score")


def search_lines(docs: DataFrame, needle: str, most: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first `most` lines, by id and line, that hold the needle."""
    hit = docs.where(F.contains(F.col(text_col), F.lit(needle))).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return hit.where(F.contains("line", F.lit(needle))).orderBy(id_col, "line_no").limit(most)


def running_totals(rows: DataFrame, value: str, order: str = "seq") -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(W.partitionBy("path").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def prefix_credit(truth: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of leading running totals (path, nth, total) that answers(path, nth, value) have right, up to the first miss."""
    joined = truth.join(answers, ["path", "nth"], "left").withColumn("wrong", (~F.col("total").eqNullSafe(F.col("value"))).cast("int"))
    missed = F.sum("wrong").over(W.partitionBy("path").orderBy("nth").rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn("missed", missed).groupBy("path").agg(F.avg((F.col("missed") == 0).cast("double")).alias("credit"))


def alternating_sum(rows: DataFrame, value: str, order: str = "seq") -> DataFrame:
    """The sum of values by turns added and subtracted, the first added."""
    nth = F.row_number().over(W.partitionBy("path").orderBy(order))
    signed = rows.withColumn("nth", nth).withColumn("signed", F.when(F.col("nth") % 2 == 1, F.col(value)).otherwise(-F.col(value)))
    return signed.groupBy("path").agg(F.sum("signed").alias("total"), F.count("*").alias("n"))


def action_repeats(steps: DataFrame) -> DataFrame:
    """steps(path, seq, signature, transient): a retry repeats the step before it after a transient error; other repeats are repeats."""
    order = W.partitionBy("path").orderBy("seq")
    rows = steps.withColumn("before", F.lag("signature").over(order)).withColumn("erred", F.lag("transient").over(order))
    seen = F.row_number().over(W.partitionBy("path", "signature").orderBy("seq")) > 1
    retry = F.coalesce((F.col("before") == F.col("signature")) & F.col("erred"), F.lit(False))
    rows = rows.withColumn("kind", F.when(retry, "retry").when(seen & ~F.col("signature").startswith("done"), "repeat").otherwise("new"))
    return rows.select("path", "seq", "signature", "kind")
