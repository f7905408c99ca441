"""Mixing sources to target weights by entropy balancing.

Sources share a budget of words by weight, and a target stops at ``cap`` times
its source's size (the excess goes to the others by weight). Document rates
then minimise the entropy relative to one copy each, under the constraint that
a source's rates give its target and no rate exceeds ``cap``. The dual of that
problem is convex with one multiplier for each source; its solution tilts the
rates exponentially in the document's size:

    rate = cap * e / (e + cap - 1),   e = exp(multiplier * size / mean size)

Newton steps find the multipliers. Each step is one job, in which PROBES
multipliers are tried for each source at once: Newton's own, and others at growing
distances from it or, between two that enclose the solution, spread over what lies
between them. So the solution is enclosed after a few steps however far it is, and
each step shrinks what encloses it at least by the number of probes. The sums run
over a histogram (source, size, count) in the cluster; they are decimals of fixed
scale, so their order cannot change a result.

Rates become copies by systematic rounding in order of size: the running sum of
rates, shifted by an offset, crosses as many whole numbers as a document gets
copies. A source's total then strays from its target by at most one document of
the largest size; of OFFSETS offsets, the one with the least error is taken.
Documents of one size in one source are dealt into buckets of BUCKET by a hash
of their id and text, so no task ranks more than a bucket (but for rows that are
equal in both). The running sums over a
source's buckets are taken in two levels: buckets are cut by range into parts,
parts are summed, and their sums run before those within each part; so one
source, however large, is spread over all tasks. Only one row of sums for each
source (some 50 bytes) meets in one task, where targets are set.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, the last; equal rows are documents of their own; texts are
counted whole in the JVM, whatever their length; an empty table gives an empty
result. Only id, source and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.common import bounded_broadcast, column, discard, table, unused, written

WORD = r"[^\x20\x09-\x0D]+"
SCALE = 10**9
OFFSETS = 32
BUCKET = 256
#: Multipliers tried at once (an odd number), and how much farther from Newton's each next pair is.
PROBES, SPREAD = 9, 8.0
#: Rows of (source, size, ...) that may be broadcast: under 100 bytes each, 20 MB in all.
BROADCAST_ROWS = 200_000


def document_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, src, size, th); src is 's' and the source, or 'z' for null, which keeps the order with null last; th is a hash of the text."""
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source)).alias("src"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col).cast("string")).alias("th"),
    )


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(src, source_size, target) from totals(src, source_size): the water level at which shares stop at their caps."""
    by_name = W.orderBy("src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("level", F.col("most") / F.col("weight"))
    everything = W.partitionBy()
    rising = W.orderBy("level", "src").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    left = F.sum("weight").over(everything) - F.sum("weight").over(rising)
    rows = rows.withColumn("full", F.sum("most").over(rising) + F.col("level") * left <= F.col("budget"))
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    even = (F.col("budget") - spent) / F.when(open_weight > 0, open_weight) * F.col("weight")
    return rows.select("src", "source_size", F.when(F.col("full"), F.col("most")).otherwise(even).alias("target"), F.col("full"))


def _units(x: Column) -> Column:
    """A rate in whole billionths."""
    return F.round(x * F.lit(float(SCALE))).cast("long")


def _rate(multiplier: Column, x: Column, cap: float) -> Column:
    tilt = F.exp(F.least(F.greatest(multiplier * x, F.lit(-500.0)), F.lit(500.0)))
    return F.lit(float(cap)) * tilt / (tilt + F.lit(float(cap) - 1.0))


def _probes(state: DataFrame) -> DataFrame:
    """state(src, ..., at, low, high) with a row for each multiplier `x` to try: `at`, and others around it."""
    half = PROBES // 2
    at, low, high = F.col("at"), F.col("low"), F.col("high")
    reach = F.greatest(F.abs(at), F.lit(1.0))
    steps = [SPREAD ** (k - half) for k in range(1, 2 * half, 2)]
    # Below at, towards low; above it, towards high. Where there is no such end yet, ever farther.
    below = [F.when(low.isNull(), at - reach * F.lit(step)).otherwise(low + (at - low) * F.lit(i / half)) for i, step in enumerate(steps)]
    above = [F.when(high.isNull(), at + reach * F.lit(step)).otherwise(high - (high - at) * F.lit(i / half)) for i, step in enumerate(steps)]
    return state.withColumn("x", F.explode(F.array_distinct(F.array(at, *below, *above))))


def multipliers(histogram: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9, max_steps: int = 60) -> DataFrame:
    """(src, mean, multiplier) that meet every target below cap times its source's size, by distributed Newton steps.

    Each step is one job, which writes the state and counts the sources that have not settled; if some have not after
    max_steps, that is an error.
    """
    rows = histogram.where("size > 0")
    mean = rows.groupBy("src").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    none = F.lit(None).cast("double")
    state = written(targets.where("not full and source_size > 0").join(mean, "src").select("src", "target", "mean", F.lit(0.0).alias("at"), none.alias("low"), none.alias("high")), "newton")
    for _ in range(max_steps):
        size = F.col("size") / F.col("mean")
        rate = _rate(F.col("x"), size, cap)
        words = (F.col("n") * F.col("size")).cast("decimal(22,0)")
        slope = rate * (1 - rate / cap) * size
        sums = (
            rows.join(_probes(state).select("src", "mean", "x"), "src")
            .groupBy("src", "x")
            .agg(F.sum(words * _units(rate).cast("decimal(12,0)")).cast("double").alias("got"), F.sum(words * _units(slope).cast("decimal(15,0)")).cast("double").alias("slope"))
        )
        tried = state.select("src", "target", "mean", "low", "high").join(sums, "src").withColumn("miss", F.col("got") / SCALE - F.col("target"))
        best = F.min(F.struct(F.abs("miss").alias("off"), F.col("x"), F.col("miss"), F.col("slope"))).alias("best")
        step = tried.groupBy("src", "target", "mean").agg(
            best, F.max(F.when(F.col("miss") <= 0, F.col("x"))).alias("under"), F.min(F.when(F.col("miss") > 0, F.col("x"))).alias("over"), F.first("low").alias("low"), F.first("high").alias("high")
        )
        step = step.withColumn("low", F.greatest("low", "under")).withColumn("high", F.least("high", "over"))
        settled = F.col("best.off") <= tolerance * F.col("target") + 0.01
        new = F.col("best.x") - F.col("best.miss") * SCALE / F.greatest(F.col("best.slope"), F.lit(1e-300))
        outside = new.isNull() | F.isnan(new) | (new <= F.col("low")) | (new >= F.col("high"))
        # Without an end on the side to which it must go, from the outermost that was tried.
        open_end = F.when(F.col("high").isNull(), F.col("low")).when(F.col("low").isNull(), F.col("high"))
        moved = F.when(open_end.isNotNull(), F.when(F.abs(new - open_end) <= F.greatest(F.abs(open_end), F.lit(1.0)) * SPREAD, new).otherwise(open_end)).when(outside, (F.col("low") + F.col("high")) / 2).otherwise(new)
        step = step.select("src", "target", "mean", F.when(settled, F.col("best.x")).otherwise(moved).alias("at"), "low", "high", settled.alias("settled"))
        counted = Observation()
        last, state = state, written(step.observe(counted, F.count_if(~F.col("settled")).alias("open")), "newton").drop("settled")
        discard(last)
        if not counted.get.get("open"):
            return state.select("src", "mean", F.col("at").alias("multiplier"))
    raise RuntimeError(f"{counted.get['open']} sources did not reach their targets in {max_steps} steps")


def running_sums(rows: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """rows with `upto`, the running sum of value in each group, in two levels: no task holds a whole group.

    Rows are cut by range and written, so a row keeps its part if a task is run again.
    """
    cut = rows.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id())
    cut = written(cut, "ranges")
    sums = cut.groupBy(group, "part").agg(F.sum(value).cast("decimal(38,0)").alias("own"))
    earlier = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    ahead = sums.select(group, "part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).cast("decimal(38,0)").alias("ahead"))
    within = W.partitionBy(group, "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = cut.join(bounded_broadcast(written(ahead, "ahead"), BROADCAST_ROWS), [group, "part"])
    return found.withColumn("upto", (F.col("ahead") + F.sum(value).over(within)).cast("decimal(38,0)")).drop("part", "ahead")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) of every row of docs."""
    sizes = written(document_sizes(docs, id_col, source_col, text_col), "sizes")
    histogram = written(sizes.groupBy("src", "size").agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(totals, weights, share, cap), "targets")
    solved = multipliers(histogram, targets, cap)
    # Rates in billionths for each (source, size); a source whose target is its cap takes cap copies of all.
    rated = histogram.join(targets, "src").join(solved, "src", "left")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean"), cap))
    rated = rated.select("src", "size", F.ceil(F.col("n") / BUCKET).cast("long").alias("buckets"), "source_size", "target", _units(F.coalesce(rate, F.lit(0.0))).alias("units"))
    dealt = sizes.join(bounded_broadcast(rated, BROADCAST_ROWS), ["src", "size"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.col("buckets")))
    dealt = written(dealt.select("doc_id", "th", "src", "size", "bucket", "source_size", "target", "units"), "dealt")
    cells = dealt.groupBy("src", "size", "bucket", "units", "target").agg(F.count("*").cast("decimal(20,0)").alias("n"))
    cells = cells.withColumn("rates", (F.col("n") * F.col("units").cast("decimal(11,0)")).cast("decimal(38,0)"))
    cells = running_sums(cells, "src", [F.desc("size"), F.col("bucket")], "rates")
    cells = written(cells.withColumn("before", (F.col("upto") - F.col("rates")).cast("decimal(38,0)")), "cells")
    # The offset of each source with the least error.
    offsets = [(2 * i + 1) * SCALE // (2 * OFFSETS) for i in range(OFFSETS)]
    took = [F.sum(F.col("size") * F.expr(f"((upto + {u}) div {SCALE}) - ((before + {u}) div {SCALE})")) - F.first("target") for u in offsets]
    errors = cells.groupBy("src").agg(*[F.abs(x).alias(f"e{i}") for i, x in enumerate(took)])
    best = F.array_min(F.array(*[F.struct(F.col(f"e{i}").alias("error"), F.lit(u).cast("long").alias("offset")) for i, u in enumerate(offsets)]))
    best = errors.select("src", best["offset"].alias("offset"))
    places = cells.select("src", "size", "bucket", "before").join(best, "src")
    ranked = dealt.withColumn("k", F.row_number().over(W.partitionBy("src", "size", "bucket").orderBy(F.xxhash64("doc_id", "th", F.lit(7)), "doc_id", "th")))
    out = ranked.join(bounded_broadcast(places, BROADCAST_ROWS), ["src", "size", "bucket"])
    copies = F.expr(f"((before + offset + k * units) div {SCALE}) - ((before + offset + (k - 1) * units) div {SCALE})")
    return out.withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", (F.col("units") / SCALE).alias("rate")
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, each as often as the mix copies it; rows with one id take the most copies any of them got.

    The columns are those of docs, under whatever names.
    """
    own, often, nth = (unused(docs, x) for x in ("mix_id", "mix_copies", "mix_nth"))
    copies = mix(docs, id_col, **options).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").cast("int").alias(often)).where(F.col(often) > 0)
    joined = docs.join(copies, column(id_col).cast("long").eqNullSafe(F.col(own)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*[column(c) for c in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the mix that SQL can say: (doc_id, size, source_size, target in thousandths of a word) of every document."""
    return op5_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round(F.col("target") * 1000).cast("long").alias("target_thousandths"))


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, 2 * source_size / weight AS level FROM w),
f AS (SELECT *, sum(2 * source_size) OVER rising + level * (sum(weight) OVER () - sum(weight) OVER rising) <= budget AS is_full FROM l WINDOW rising AS (ORDER BY level, k)),
t AS (SELECT source, source_size, CASE WHEN is_full THEN 2.0 * source_size ELSE (budget - sum(CASE WHEN is_full THEN 2 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target FROM f)
SELECT d.doc_id, d.size, t.source_size, CAST(round(t.target * 1000) AS BIGINT) AS target_thousandths FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
