"""Sessions cut into ranges: values and states are those of the whole, and no stage reads a session in one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from runloom.operators import detectors, ranges
from runloom.operators.fold import Limits, fold
from runloom.schema import EVENTS
from tests.test_fold import random_events


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [r for seed in range(4) for r in random_events(spark, seed, 150, unique=seed % 2 == 0).collect()]
    return spark.createDataFrame(rows, EVENTS).persist()


@pytest.mark.parametrize("size", [None, 1, 50])
def test_running_values_are_those_of_the_rows_before(spark, size):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(-5, 9), rng.choice([None, None, i])) for i in rng.sample(range(400), 200)]
    got = ranges.running(spark.createDataFrame(rows, "path string, seq long, x long, y long").repartition(5), size, sums={"total": F.col("x"), "n": F.lit(1)}, lasts={"seen": F.col("y")}).collect()
    want = {}
    for path, seq, _, _ in rows:
        before = sorted((r for r in rows if r[0] == path and r[1] < seq), key=lambda r: r[1])
        want[path, seq] = (sum(r[2] for r in before), len(before), next((r[3] for r in reversed(before) if r[3] is not None), None))
    assert {(r["path"], r["seq"]): (r["total"], r["n"], r["seen"]) for r in got} == want


@pytest.mark.parametrize(("size", "limits"), [(10_000, Limits(max_facts=1000)), (7, Limits(loop_repeats=3, loop_window=6, loop_clear_after=2, streak=2, flood_cap=9, warn_usd=0.004, critical_usd=0.009, stall_s=60))])
def test_state_is_that_of_the_fold_wherever_it_is_cut(sessions, size, limits):
    got = {r["path"]: r.asDict(recursive=True) for r in ranges.state(sessions, limits, size).collect()}
    want = {r["path"]: r.asDict(recursive=True) for r in fold(sessions, limits).collect()}
    assert got.keys() == want.keys()
    for path, w in want.items():
        g = got[path]
        for name in ("observed_seq", "session_id", "n_events", "sidechain_events", "n_turns", "n_tool_calls", "n_tool_errors", "goal_text", "latest_user_directive", "last_agent_text", "frontier", "started_us", "last_us", "tokens", "models", "tools", "files", "recent_failures", "facts"):
            assert g[name] == w[name], (path, name)
        assert g["cost_usd"] == pytest.approx(w["cost_usd"], abs=1e-12)
        assert [(p["correlation_id"], p["call_seq"]) for p in g["pending"]] == [(p["correlation_id"], p["call_seq"]) for p in w["pending"]]
        life = lambda rows: sorted((a["kind"], a["severity"], a["detected_at_seq"], str(a["cleared_at_seq"])) for a in rows)
        assert life(g["anomalies"]) == life(w["anomalies"])


def test_more_facts_than_the_cap_are_refused(sessions):
    with pytest.raises(Exception, match="more facts than the cap"):
        ranges.state(sessions, Limits(max_facts=2)).collect()


def test_no_window_has_a_session_alone(sessions):
    """Windows by path alone run over one row for each range or segment; those over events are by range or by id as well."""
    plan = detectors.life_cycles(sessions, size=50)._jdf.queryExecution().optimizedPlan().toString()
    alone = re.findall(r"Window \[(.*?)\], \[(path#\d+(?:, tool_name#\d+)?)\], \[(\w+)", plan)
    assert alone and {order for _, _, order in alone} == {"_range"}


def _watched(spark, rows):
    """rows, and a counter of how many of them have been computed."""
    computed = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(pass_on, rows.schema), computed


def test_running_values_of_running_values_compute_their_rows_once(spark):
    rows, computed = _watched(spark, spark.range(200).select(F.lit("p").alias("path"), F.col("id").alias("seq")))
    for n in ("a", "b", "c"):
        rows = ranges.running(rows, 16, sums={n: F.col("seq") if n == "a" else F.lit(1)}, lasts={f"last_{n}": F.col("seq")})
    got = {r["seq"]: (r["a"], r["b"], r["c"], r["last_c"]) for r in rows.collect()}
    assert got == {i: (i * (i - 1) // 2, i, i, i - 1 if i else None) for i in range(200)}
    assert computed.value == 200


def test_life_cycles_in_ranges_compute_the_events_once(spark, sessions):
    events, computed = _watched(spark, sessions)
    got = detectors.life_cycles(events, size=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, detectors.life_cycles(sessions).collect())) and got
    assert computed.value == sessions.count()


def test_one_long_session_is_spread_over_tasks(spark):
    """A session of 300,000 events: no task reads more than a few of its ranges."""
    n, size = 300_000, 4096
    e = spark.range(n).select(
        F.lit("p").alias("path"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "tool_call").when(F.col("id") % 3 == 1, "tool_result").otherwise("thinking").alias("kind"), F.lit("agent").alias("source"),
        F.concat(F.lit("c"), F.expr("id div 3")).alias("correlation_id"), F.timestamp_seconds("id").alias("ts"),
    )
    from runloom.sources.adapters import canonical

    rows = ranges.running(canonical(e).select("path", "seq", "kind"), size, sums={"calls": (F.col("kind") == "tool_call").cast("long")})
    spread = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in spread) == n and max(r["n"] for r in spread) < 0.6 * n
    assert rows.agg(F.max("calls")).first()[0] == n // 3
