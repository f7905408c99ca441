"""Life cycles of anomalies as native plans against those of the fold, on sessions that use ids again."""

import pytest
from pyspark.sql import functions as F

from runloom.operators import detectors
from runloom.operators.fold import Limits, anomalies, fold
from runloom.schema import EVENTS
from tests.test_fold import random_events

COLUMNS = ["path", "kind", "severity", "detected_at_seq", "cleared_at_seq"]


@pytest.fixture(scope="module")
def sessions(spark):
    rows = []
    for seed in range(8):
        rows += random_events(spark, seed, 220, unique=seed % 3 == 0).collect()
    return spark.createDataFrame(rows, EVENTS).persist()


@pytest.mark.parametrize(
    "limits",
    [
        Limits(loop_repeats=3, loop_window=6, loop_clear_after=2, streak=2, flood_cap=9, warn_usd=0.004, critical_usd=0.009, stall_s=60),
        Limits(loop_repeats=2, loop_window=4, loop_clear_after=4, streak=1, flood_cap=30, flood_caps={"Run": 3}, warn_usd=0.001, critical_usd=0.002, stall_s=1),
        Limits(loop_repeats=4, loop_window=24, loop_clear_after=6, streak=4, flood_cap=1, stall_s=2000),
    ],
)
def test_intervals_are_those_of_the_fold(sessions, limits):
    got, want = detectors.life_cycles(sessions, limits).persist(), anomalies(fold(sessions, limits)).select(*COLUMNS).persist()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    kinds = {r["kind"]: (r["n"], r["cleared"]) for r in want.groupBy("kind").agg(F.count("*").alias("n"), F.count("cleared_at_seq").alias("cleared")).collect()}
    assert kinds["stall"][1] and kinds["loop"][1] and kinds["error_streak"][1]


def test_open_calls_of_a_gap_are_those_in_flight(sessions):
    """Plainly: the ids called since the last user message without a result since their last call."""
    got = {(r["path"], r["seq"]): r["open_calls"] for r in detectors.stall_gaps(sessions, 1).collect()}
    want, state = {}, {}
    for r in sessions.where("agent_id IS NULL").orderBy("path", "seq").collect():
        flying, last = state.setdefault(r["path"], (set(), [None]))
        if last[0] is not None and flying and (r["ts"] - last[0]).total_seconds() >= 1:
            want[r["path"], r["seq"]] = len(flying)
        last[0] = r["ts"]
        ident = r["correlation_id"]
        if r["kind"] == "message" and r["source"] == "user":
            flying.clear()
        elif r["kind"] == "tool_call" and ident:
            flying.add(ident)
        elif r["kind"] == "tool_result":
            flying.discard(ident)
    assert got == want and len(want) > 100


def test_no_events_have_no_anomalies(spark):
    assert detectors.life_cycles(spark.createDataFrame([], EVENTS)).collect() == []


def test_scores_of_detections_fold_the_sessions_once(spark):
    from runloom.plans import catalogue

    plan = catalogue.QUERIES["detection_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan
