import re

import pytest
from pyspark.sql import functions as F

from runloom.llm import mixing as M


def water(sizes, weights, share, cap):
    """Iterative resharing, as stated."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        left = budget - sum(target.values())
        even = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if even[s] > cap * sizes[s]]
        if not over:
            return target | even
        for s in over:
            target[s] = cap * sizes[s]
            open_.discard(s)
    return target


@pytest.fixture(scope="module")
def mixed(corpus):
    rows, df = corpus
    return rows, [r.asDict() for r in M.mix(df).collect()], [r.asDict() for r in M.mix(df.repartition(2)).collect()]


def test_targets_and_sizes(mixed):
    rows, got, _ = mixed
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(M.WORD, r[1] or ""))
    want = water(size, (5, 2, 1), 1.5, 2.0)
    of = {r[0]: r[3] for r in rows if r[0] is not None}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["source_size"] == size[of[r["doc_id"]]]
            assert r["target"] == pytest.approx(want[of[r["doc_id"]]], rel=1e-9)
            assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]


def test_taken_is_near_target(mixed):
    _, got, _ = mixed
    for target in {r["target"] for r in got}:
        some = [r for r in got if r["target"] == target]
        assert abs(sum(r["taken"] for r in some) - target) <= max(r["size"] for r in some)


def test_reruns_agree(mixed):
    _, a, b = mixed
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_rates_solve_the_dual(spark):
    hist = spark.createDataFrame([("sa", i, 10) for i in range(1, 50)] + [("sb", 3, 100)], "src string, size long, n long")
    targets = spark.createDataFrame([("sa", 12250, 15000.0, False), ("sb", 300, 100.0, False)], "src string, source_size long, target double, full boolean")
    for r in M.multipliers(hist, targets, 2.0).collect():
        import math

        rows = [(i, 10) for i in range(1, 50)] if r["src"] == "sa" else [(3, 100)]
        got = sum(n * s * 2 / (1 + math.exp(-r["multiplier"] * s / r["mean"])) for s, n in rows)
        assert got == pytest.approx(15000 if r["src"] == "sa" else 100, rel=1e-6)


def test_sources_that_do_not_settle_are_an_error(spark):
    hist = spark.createDataFrame([("sa", i, 10) for i in range(1, 50)], "src string, size long, n long")
    targets = spark.createDataFrame([("sa", 12250, 23000.0, False)], "src string, source_size long, target double, full boolean")
    with pytest.raises(RuntimeError, match="did not reach"):
        M.multipliers(hist, targets, 2.0, max_steps=1)


@pytest.mark.parametrize("share", [0.001, 0.5, 1.0, 1.9995, 1.99999])
def test_unequal_sizes_settle_however_near_the_cap(spark, share, monkeypatch):
    """200 texts of one word and one of 200,000: multipliers of tens of thousands; and few steps, each of which is a table."""
    docs = spark.createDataFrame([(i, "w", "a") for i in range(200)] + [(1000, "w " * 200_000, "a")], "doc_id long, text string, source string")
    steps, written = [], M.written
    monkeypatch.setattr(M, "written", lambda df, label: steps.append(label) or written(df, label))
    got = M.mix(docs, share=share).collect()
    target = share * 200_200
    assert abs(sum(r["rate"] * r["size"] for r in got) - target) <= 1e-9 * target + 0.02
    assert abs(sum(r["taken"] for r in got) - target) <= 200_000
    assert all(0 <= r["rate"] <= 2 for r in got) and steps.count("newton") <= 16


def test_one_id_does_not_make_one_bucket(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("a").alias("source"))
    got = M.mix(docs, share=0.5).collect()
    assert abs(sum(r["taken"] for r in got) - 1500) <= 1


def test_running_sums_spread_one_group(spark):
    """One group over several parts, sums beyond 64 bits, groups that begin within a part."""
    rows = [("one", i * 7919 % 3001, 10**18 + i) for i in range(3000)] + [("two", i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, at long, v long").withColumn("v", F.col("v").cast("decimal(38,0)"))
    got = {(r["g"], r["at"]): int(r["upto"]) for r in M.running_sums(df, "g", [F.desc("at")], "v").collect()}
    for g in ("one", "two"):
        total = 0
        for _, at, v in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]):
            total += v
            assert got[g, at] == total
    plan = M.running_sums(df, "g", [F.desc("at")], "v")._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(g#\d+, \d", plan)


def test_rates_against_bisection(mixed):
    """For each source the multiplier is found by halving, over its documents one by one; a full source has its cap."""
    import math

    rows, got, _ = mixed
    source = {r[0]: r[3] for r in rows if r[0] is not None} | {None: rows[-1][3]}
    by: dict = {}
    for r in got:
        by.setdefault(source[r["doc_id"]], []).append(r)
    for some in by.values():
        target, mean = some[0]["target"], [r["size"] for r in some if r["size"]]
        if not mean:
            continue
        mean = sum(mean) / len(mean)
        rate = lambda m, size: 2 / (1 + math.exp(-m * size / mean))
        low, high = -60.0, 60.0
        for _ in range(200):
            at = (low + high) / 2
            low, high = (at, high) if sum(r["size"] * rate(at, r["size"]) for r in some) < target else (low, at)
        full = target >= 2 * some[0]["source_size"] * (1 - 1e-12)
        for r in some:
            if r["size"]:
                assert r["rate"] == pytest.approx(2.0 if full else rate(at, r["size"]), abs=1e-4)


def test_copies_follow_the_rates(mixed):
    """Systematic rounding: every document gets its rate rounded up or down."""
    _, got, _ = mixed
    assert all(abs(r["copies"] - r["rate"]) < 1 and 0 <= r["rate"] <= 2 for r in got)


def test_query(spark, corpus, tmp_path):
    corpus[1].write.parquet(f"{tmp_path}/documents.parquet")
    df = M.op5_mix_sources(spark, str(tmp_path))
    assert df.dtypes[:5] == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert df.count() == len(corpus[0])


def test_empty_and_wordless(spark, no_docs):
    assert M.mix(no_docs).count() == 0
    only = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 0)], no_docs.schema)
    assert [(r["size"], r["target"], r["taken"]) for r in M.mix(only).collect()] == [(0, 0.0, 0)] * 2
