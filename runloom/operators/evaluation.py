"""Evaluation: detections against labelled intervals, grades of answers, means of runs, comparison with an oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions import expressions as X

SLACK_EVENTS = 6
#: Events of a session by which spans and detections are brought together.
BLOCK = 256


def label_spans(labels: DataFrame, events: DataFrame) -> DataFrame:
    """labels(path, kind, start_line, end_line) with the least and greatest seq of the events on those lines.

    As events follow the lines, these are the first event from the start line on and the last up to the end line: lookups
    in one window over a path's lines and label ends, so no label meets all events of its path.
    """
    mark = lambda line, end: F.struct(line.cast("long").alias("line"), end.alias("end"))
    named = labels.select("path", "kind", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    ends = named.distinct().withColumn("at", F.explode(F.array(mark(F.col("start_line"), F.lit(0)), mark(F.col("end_line"), F.lit(2)))))
    ends = ends.select("path", "kind", "start_line", "end_line", "at.line", "at.end", F.lit(None).cast("long").alias("seq"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("start_line", "long"), ("end_line", "long"))]
    rows = events.select("path", *none, F.col("raw.line_no").alias("line"), F.lit(1).alias("end"), "seq").unionByName(ends)
    order = W.partitionBy("path").orderBy("line", "end")
    following = F.min("seq").over(order.rowsBetween(0, W.unboundedFollowing))
    upto = F.max("seq").over(order.rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("lo", F.when(F.col("end") == 0, following)).withColumn("hi", F.when(F.col("end") == 2, upto)).where("kind is not null")
    return found.groupBy("path", "kind", "start_line", "end_line").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <= hi")


def matches(spans: DataFrame, anomalies: DataFrame, slack: int = SLACK_EVENTS) -> DataFrame:
    """Pairs of a span(path, kind, lo, hi) and an anomaly(path, kind, detected_at_seq, evidence) that fires within it.

    Spans and places are dealt into blocks of BLOCK events and meet by path, kind and block, so what lies far apart in a
    session never meets; an anomaly has EVIDENCE places at most.
    """
    block = lambda c: F.expr(f"{c} div {BLOCK}")
    dealt = spans.withColumn("block", F.explode(F.sequence(block("lo"), block(f"(hi + {slack})"))))
    fired = anomalies.select("*", F.explode(F.array_distinct(F.concat("evidence", F.array("detected_at_seq")))).alias("place"))
    met = dealt.join(fired.withColumn("block", block("place")), ["path", "kind", "block"]).where(F.col("place").between(F.col("lo"), F.col("hi") + slack))
    return met.drop("block", "place").dropDuplicates(["path", "kind", "lo", "hi", "detected_at_seq"])


def detection_scores(spans: DataFrame, anomalies: DataFrame, slack: int = SLACK_EVENTS) -> DataFrame:
    """True and false positives, misses, precision, recall and mean lead (events from a span's end back to its detection) by kind."""
    hit = matches(spans, anomalies, slack)
    found = hit.groupBy("path", "kind", "lo", "hi").agg(F.min("detected_at_seq").alias("first")).withColumn("lead", F.col("hi") - F.col("first"))
    tp = found.groupBy("kind").agg(F.count("*").alias("tp"), F.avg("lead").alias("mean_lead"))
    total = spans.groupBy("kind").agg(F.count("*").alias("labels"))
    false = anomalies.join(hit.select("path", "kind", "detected_at_seq").distinct(), ["path", "kind", "detected_at_seq"], "left_anti").groupBy("kind").agg(F.count("*").alias("fp"))
    out = total.join(tp, "kind", "full").join(false, "kind", "full").na.fill(0, ["labels", "tp", "fp"])
    share = lambda n, d: F.when(d > 0, n / d)
    return out.select("kind", "tp", "fp", (F.col("labels") - F.col("tp")).alias("fn"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("labels")).alias("recall"), "mean_lead")


def compare(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """(path, field, equal) of every field of two tables, rows of either side included."""
    fields = [c for c in left.columns if c != key]
    joined = left.alias("a").join(right.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    parts = [F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).alias("equal")) for f in fields]
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array(*parts)).alias("x")).select(key, "x.field", "x.equal")


def fidelity(compared: DataFrame) -> DataFrame:
    return compared.groupBy("field").agg(F.count_if("equal").alias("equal"), F.count("*").alias("total"))


def policy_means(runs: DataFrame, by: str = "policy") -> DataFrame:
    """Means of the numeric and boolean columns of runs by policy; a crashed run has nulls, which do not count."""
    kept = [c for c, t in runs.dtypes if c != by and (t in ("boolean", "int", "bigint", "double", "float") or t.startswith("decimal"))]
    return runs.groupBy(by).agg(F.count("*").alias("runs"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in kept])


def condition_accuracy(scores: DataFrame) -> DataFrame:
    """scores(condition, qid, transcript, score): mean by condition, question and transcript in one pass of grouping sets."""
    sets = scores.groupingSets([["condition"], ["condition", "qid"], ["condition", "transcript"]], "condition", "qid", "transcript")
    return sets.agg(F.avg("score").alias("accuracy"), F.count("*").alias("n"))


def grade(rows: DataFrame) -> DataFrame:
    """rows(kind, truth array<string>, answer string) with a score from 0 to 1; a null answer scores 0.

    exact_int compares the first whole number of the answer; exact_str asks that
    the answer holds the truth. substring_of_truth asks that it holds the truth's
    first 40 characters, or that the truth holds 60 % of its words of over three
    letters. set_f1 cuts the answer at commas, semicolons and line feeds and takes
    the F1 of the two sets, whose members match when one holds the other; an empty
    truth is met by "none" or nothing.
    """
    truth = F.transform("truth", X.normalised_answer)
    t, a = F.coalesce(F.get(truth, F.lit(0)), F.lit("")), X.normalised_answer(F.col("answer"))
    number = F.regexp_extract(a, "-?[0-9]+", 0).try_cast("decimal(38,0)")
    words = F.filter(F.split(a, " "), lambda w: F.length(w) > 3)
    head = F.substring(t, 1, 40)
    share = F.size(F.filter(words, lambda w: F.contains(t, w))) / F.greatest(F.size(words), F.lit(1))
    given = F.filter(F.array_distinct(F.transform(F.split("answer", "[\\n,;]+"), X.normalised_answer)), lambda x: ~x.isin("", "none"))
    meets = lambda x, others: F.exists(others, lambda y: F.contains(x, y) | F.contains(y, x))
    precision = F.size(F.filter(given, lambda x: meets(x, truth))) / F.greatest(F.size(given), F.lit(1))
    recall = F.size(F.filter(truth, lambda x: meets(x, given))) / F.greatest(F.size(truth), F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    f1 = F.when(F.size(truth) == 0, (F.contains(a, F.lit("none")) | (a == "")).cast("double")).otherwise(f1)
    score = F.when(F.col("answer").isNull(), 0.0)
    score = score.when(F.col("kind") == "exact_int", F.coalesce(number == t.try_cast("decimal(38,0)"), F.lit(False)).cast("double"))
    score = score.when(F.col("kind") == "exact_str", F.contains(a, t).cast("double"))
    score = score.when(F.col("kind") == "substring_of_truth", (((head != "") & F.contains(a, head)) | ((F.size(words) > 0) & (share >= 0.6))).cast("double"))
    return rows.withColumn("score", score.otherwise(f1))


def spend_check(spend: DataFrame, cap_usd: float = 5000.0) -> DataFrame:
    return spend.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_usd")).withColumn("over", F.col("total_usd") >= cap_usd)
