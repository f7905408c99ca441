import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.operators import correlation, counters, detectors, episodes, facts
from runloom.operators.fold import Facts, Limits, SessionFold, anomalies, fold
from runloom.schema import EVENTS
from runloom.sources.adapters import canonical

BASE = {"source": "agent", "main": True, "turn": False, "said": None, "head": "", "id": "", "tool": "", "sha256": "", "input_source": None, "hint": "", "file": None, "bad": False, "us": None, "session_id": "s", "usage_key": None, "model": None, "tokens": None, "micros": None, "facts": None}


def run(rows, **limits):
    held = SessionFold(Limits(**limits))
    for i, r in enumerate(rows):
        held.step(BASE | {"seq": i} | r)
    return held.state("p")


def call(ident="", tool="T", sha="x", **kw):
    return {"kind": "tool_call", "id": ident, "tool": tool, "sha256": sha, **kw}


def result(ident="", bad=False, **kw):
    return {"kind": "tool_result", "source": "tool", "id": ident, "bad": bad, **kw}


def turn(text="do it", **kw):
    return {"kind": "message", "source": "user", "turn": True, "said": text, **kw}


def intervals(state, kind):
    return [(a["severity"], a["detected_at_seq"], a["cleared_at_seq"]) for a in state["anomalies"] if a["kind"] == kind]


@pytest.mark.parametrize(("n", "want"), [(3, []), (4, [("warn", 3, None)]), (5, [("critical", 3, None)])])
def test_loop_threshold(n, want):
    assert intervals(run([call()] * n), "loop") == want


def test_loop_window_and_clearing():
    other = [call(sha=f"o{i}") for i in range(30)]
    assert intervals(run([call()] * 3 + other[:20] + [call()]), "loop") == [("warn", 23, None)]  # the first is 24 calls back
    assert intervals(run([call()] * 3 + other[:21] + [call()]), "loop") == []
    assert intervals(run([call()] * 4 + other[:5]), "loop") == [("warn", 3, None)]
    assert intervals(run([call()] * 4 + other[:6]), "loop") == [("warn", 3, 9)]


@pytest.mark.parametrize(("n", "want"), [(2, []), (3, [1, 2, 3]), (12, list(range(1, 13))), (13, [1, *range(3, 14)])])
def test_streak_evidence(n, want):
    state = run([turn()] + [result(bad=True)] * n + [result()])
    assert [a["evidence"] for a in state["anomalies"]] == ([want] if want else [])
    assert all(a["cleared_at_seq"] == n + 1 for a in state["anomalies"])


def test_streak_of_fourteen_re_adds_what_the_ring_lost():
    state = run([turn()] + [result(bad=True)] * 14)
    assert state["anomalies"][0]["evidence"] == [1, *range(5, 14), 2, 14]


@pytest.mark.parametrize(("n", "want"), [(99, []), (100, [("warn", 99, None)])])
def test_flood_cap(n, want):
    assert intervals(run([call(sha=str(i)) for i in range(n)]), "tool_flood") == want
    assert intervals(run([call(tool="", sha=str(i)) for i in range(n)]), "tool_flood") == []


def test_budget_levels():
    paid = lambda k, usd: call(sha=k, usage_key=k, micros=f"{int(usd * 1e6)}.0000", tokens=[1, 2, 3, 4], model="m")
    assert intervals(run([paid("a", 15), paid("b", 15)], warn_usd=20, critical_usd=40), "budget") == [("warn", 1, None)]
    state = run([paid("a", 15), paid("b", 15), paid("b", 99), paid("c", 15)], warn_usd=20, critical_usd=40)
    assert intervals(state, "budget") == [("critical", 1, None)]
    assert state["cost_usd"] == 45.0 and state["tokens"] == [3, 6, 9, 12] and state["models"] == [{"name": "m", "n": 3}]


@pytest.mark.parametrize(("gap", "n"), [(599, 0), (600, 1)])
def test_stall_gap(gap, n):
    rows = [call("a", us=0), result("a", us=gap * 1_000_000)]
    assert len(intervals(run(rows), "stall")) == n
    assert intervals(run([call("a", us=0), result("a", us=1), call("", us=10**12)]), "stall") == []
    assert intervals(run([*rows, {"kind": "message", "source": "user", "said": ""}]), "stall") == ([("warn", 1, 2)] if n else [])


def test_side_chains_count_but_do_not_act():
    state = run([turn(), call("a", main=False, usage_key="u", micros="1000000.0000", tokens=[1, 0, 0, 0], model=None)])
    assert (state["n_events"], state["sidechain_events"], state["n_tool_calls"], state["cost_usd"], state["pending"]) == (2, 1, 0, 1.0, [])


def test_facts_versions_eviction_and_reread():
    note = Facts(3)
    for value in ("1", "2", "1", "2"):
        note.note("f", "k", value)
    assert {k: v for k, (v, _) in note.live.items()} == {"f:k": "1", "f:k#2": "2"}
    for i in range(3):
        note.note(f"g{i}", "k", str(10 + i))
    assert list(note.live) == ["g0:k", "g1:k", "g2:k"]
    assert note.folded["k"][:2] == (2, 3) and list(note.keys) == ["f:k", "f:k#2"]
    note.note("f", "k", "1")  # an evicted key is read again, and with a new value: both change nothing
    note.note("f", "k", "7")
    assert note.folded["k"][1] == 3 and list(note.live) == ["g0:k", "g1:k", "g2:k"]
    for i in range(4):
        note.note(None, f"t{i}", "no number")
    assert "t0" not in note.folded and note.folded["k"][0] == 5


@pytest.mark.parametrize("n", [120, 121, 150])
def test_the_sum_of_all_facts_survives_eviction(n):
    rows = []
    for i in range(1, n + 1):
        rows += [call(f"c{i}", sha=str(i), input_source=f"/f{i}"), result(f"c{i}", facts=[{"key": "delta", "value": str(i)}])]
    for state in (run(rows), run(rows + rows[:2])):  # the first file is read again
        total = sum(int(f["value"]) for f in state["facts"]) + sum(int(a["total"]) for a in state["aggregates"])
        assert len(state["facts"]) == 120 and total == n * (n + 1) // 2


def heads(state):
    out = {}
    for v in state["versions"]:
        out[v["node_id"]] = v
    return out


def test_interrupted_then_late_result():
    state = run([turn("one"), call("a"), turn("two"), result("a", bad=True), result("a"), call("b")])
    one, two = heads(state)["ep-0001"], heads(state)["ep-0002"]
    assert [v["producer"] for v in state["versions"] if v["node_id"] == "ep-0001"] == ["deterministic", "deterministic", "hindsight:interrupted", "hindsight:late-result"]
    assert (one["status"], one["errors"], one["resolved"], one["dangling"], one["pins"]) == ("errors", 1, ["a"], ["T"], [3])
    assert (two["status"], two["n_calls"], two["errors"], two["dangling"]) == ("unresolved", 1, 0, ["T"])
    assert one["content"].endswith("[hindsight: dangling tool returned with error]")


@pytest.mark.parametrize(("fed", "versions"), [(19, 2), (20, 3), (21, 3), (40, 4)])
def test_periodic_versions(fed, versions):
    assert len(run([turn()] + [{"kind": "thinking"}] * fed)["versions"]) == versions


def test_a_turn_without_time_has_no_duration():
    assert heads(run([turn(), call("a", us=5), result("a", us=9)]))["ep-0001"]["duration_us"] is None
    assert heads(run([turn(us=1), call("a", us=5), result("a", us=9)]))["ep-0001"]["duration_us"] == 8


class Talk:
    """A detector of the user's own: too many messages in a row."""

    def __init__(self):
        self.n = 0

    def observe(self, row, state):
        self.n = self.n + 1 if row["kind"] == "message" else 0
        if self.n >= 2:
            state.fire("talk", "info", row["seq"], [row["seq"]], message=f"{self.n} messages in a row")
        else:
            state.clear("talk", row["seq"])


def test_detectors_of_the_user(spark):
    held = SessionFold(detectors=(Talk,))
    for i, r in enumerate([turn(), turn(), turn(), call("a")]):
        held.step(BASE | {"seq": i} | r)
    assert [(a["message"], a["detected_at_seq"], a["cleared_at_seq"]) for a in held.state("p")["anomalies"]] == [("3 messages in a row", 1, 3)]
    assert "talk" in {r["kind"] for r in anomalies(fold(random_events(spark, 1), detectors=(Talk,))).collect()}


def random_events(spark, seed, n=160, unique=True):
    rng = random.Random(seed)
    rows, calls = [], 0
    for seq in range(n):
        kind = rng.choice(["message", "message", "tool_call", "tool_call", "tool_result", "tool_result", "tool_result", "error", "thinking"])
        source = {"message": rng.choice(["user", "agent"]), "tool_result": "tool"}.get(kind, "agent")
        ident = None
        if kind == "tool_call":
            calls += 1
            ident = rng.choice([None, f"c{calls}", f"c{calls}"]) if unique else f"c{rng.randint(0, 5)}"
        elif kind == "tool_result":
            ident = rng.choice([None, *[f"c{rng.randint(1, calls + 2)}"] * 4])
        text = {"message": rng.choice(["ask", " ", "<tag>", "[Request interrupted by user]", "more"]), "tool_result": f"alpha = {rng.randint(0, 4)}\nretries = 1\nno fact", "tool_call": '{"file_path": "/f%d", "x": 1}' % rng.randint(0, 2)}.get(kind, "t")
        rows.append((f"p{seed}", seq, kind, source, None if rng.random() < 0.9 else "sidechain", ident, text, rng.choice(["Read", "Run", None]), kind == "tool_result" and rng.random() < 0.5, seq * rng.choice([1, 40]) * 1_000_000, rng.choice(["m1", "m2", None, "", f"m{seq}"]), rng.random() < 0.4))
    df = spark.createDataFrame(rows, "path string, seq long, kind string, source string, agent_id string, correlation_id string, text string, tool string, bad boolean, us long, api_message_id string, used boolean")
    from runloom.functions.expressions import payload

    usage = F.struct(F.lit("claude-haiku").alias("model"), F.col("seq").alias("input_tokens"), F.lit(3).cast("long").alias("output_tokens"), F.lit(1).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"))
    raw = F.struct(F.col("path").alias("path"), (F.col("seq") + 1).alias("line_no"), F.col("seq").alias("byte_offset"), F.lit(0).alias("block_index"))
    return canonical(df.select("path", "seq", "kind", "source", "agent_id", "correlation_id", "api_message_id", F.lit("s").alias("session_id"), F.concat(F.lit("r"), "seq").alias("record_id"), F.timestamp_micros("us").alias("ts"), payload(F.col("text"), F.col("tool"), F.col("bad")).alias("payload"), F.when(F.col("used"), usage).alias("usage"), raw.alias("raw")))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_native_plans_equal_the_fold(spark):
    events = random_events(spark, 0)
    for seed in range(1, 8):
        events = events.union(random_events(spark, seed))
    events = spark.createDataFrame(events.collect(), EVENTS).persist()
    state = fold(events).persist()
    same(state.select("path", "n_events", "sidechain_events", "n_turns", "n_tool_calls", "n_tool_errors"), counters.session_counters(events))
    same(state.select("path", F.explode("tools").alias("t")).select("path", "t.name", "t.n"), counters.per_tool(events).select("path", F.col("tool_name").alias("name"), "n"))
    same(state.select("path", F.explode("pending").alias("p")).select("path", "p.correlation_id", "p.call_seq"), correlation.pending_calls(events).select("path", "correlation_id", "call_seq"))
    same(state.select("path", F.explode("files").alias("f")).select("path", "f.name", "f.n"), counters.files_touched(events).select("path", F.col("file").alias("name"), "n"))
    same(state.select("path", F.explode("recent_failures").alias("failure")), counters.recent_failures(events).select("path", "failure"))
    same(state.select("path", F.round("cost_usd", 9).alias("c")), counters.usage_totals(events).select("path", F.round("cost_usd", 9).alias("c")))
    same(state.select("path", "goal_text", "latest_user_directive", "last_agent_text", "frontier"), counters.position(events).select("path", "goal_text", "latest_user_directive", "last_agent_text", "frontier"))
    same(state.select("path", "started_us", "last_us"), counters.session_clock(events).select("path", "started_us", "last_us"))
    same(state.select("path", F.explode("facts").alias("f")).select("path", "f.*"), facts.fact_versions(events).select("path", "key", "value"))
    same(anomalies(state).where("kind = 'error_streak'").select("path", "detected_at_seq", "cleared_at_seq"), detectors.error_streaks(events).select("path", "detected_at_seq", "cleared_at_seq"))
    last = state.select("path", F.explode("versions").alias("v")).groupBy("path", "v.node_id").agg(F.max_by("v", "v.version").alias("v"))
    cols = ["covered_lo", "covered_hi", "ask", "n_calls", "errors", "status", "conclusion", "duration_us"]
    same(last.select("path", "node_id", *[f"v.{c}" for c in cols], F.col("v.version").cast("long").alias("n_versions")), episodes.episodes(events).select("path", "node_id", *cols, "n_versions"))
    first_stall = anomalies(state).where("kind = 'stall'").groupBy("path").agg(F.min("detected_at_seq").alias("seq"))
    same(first_stall, detectors.stall_gaps(events).groupBy("path").agg(F.min("seq").alias("seq")))


def test_pending_with_ids_that_are_used_again(spark):
    events = spark.createDataFrame(random_events(spark, 3, unique=False).collect(), EVENTS).persist()
    state = fold(events)
    same(state.select("path", F.explode("pending").alias("p")).select("path", "p.correlation_id", "p.call_seq"), correlation.pending_calls(events).select("path", "correlation_id", "call_seq"))


step = st.sampled_from([turn(), turn("x"), call("a"), call("b"), call("", sha="y"), result("a"), result("b", bad=True), result("zz", bad=True), {"kind": "error"}, {"kind": "message", "said": "hm"}])


@settings(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(step, max_size=60), st.integers(0, 60))
def test_any_cut_gives_the_same_state(rows, cut):
    import pickle

    held = SessionFold()
    for i, r in enumerate(rows):
        if i == cut:
            held = pickle.loads(pickle.dumps(held))
        held.step(BASE | {"seq": i} | r)
    state = held.state("p")
    assert state == run(rows)
    chain = {}
    for v in state["versions"]:
        assert v["version"] == chain.get(v["node_id"], 0) + 1
        chain[v["node_id"]] = v["version"]


def test_empty(spark):
    assert fold(spark.createDataFrame([], EVENTS)).count() == 0
