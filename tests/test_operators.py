import json
import os
import random

import pytest
from pyspark.sql import functions as F

from runloom import cli
from runloom.functions import expressions as X
from runloom.operators import comprehension, contexts, counters, evaluation, extract, nodes, recount, views
from runloom.operators.fold import fold
from runloom.sources import fixtures, transcripts


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_expressions(spark):
    assert column(spark, X.strip, [" \t\u00a0\u2003x\u001c \n", "a b"]) == ["x", "a b"]
    assert column(spark, X.base_key, ["/a:b:k#2", "k", "k#3", "C:\\x:k"]) == ["k"] * 4
    assert [None if v is None else int(v) for v in column(spark, X.whole_number, [" +12 ", "-3", "1_000", "1.5", "", "9" * 30, None])] == [12, -3, None, None, None, int("9" * 30), None]
    assert column(spark, X.normalised_answer, ["  A \n b\u00a0C "]) == ["a b c"]
    assert [float(v) for v in column(spark, lambda c: X.price(c, "output"), ["claude-haiku-x", "x-claude-opus", None, "", "test-premium"])] == [4.0, 75.0, 15.0, 15.0, 75.0]


def test_fact_line_pattern(spark):
    fits = ["ab = 1", " _x.y-z =  two words  ", "k" * 41 + " = v", "ké = v", "kk = " + "v" * 120]
    fails = ["a = 1", "k" * 42 + " = v", "ab =", "1b = 2", "kk = " + "v" * 121]
    assert column(spark, lambda c: c.rlike(X.FACT_LINE), fits + fails) == [True] * len(fits) + [False] * len(fails)


def test_arg_hint_and_files(spark):
    rows = [("Read", '{"file_path": "/a", "n": 1}', False), ("Read", '{"notebook_path": "/b"}', False), ("Write", '{"x": 1, "path": "/c"}', False), ("Write", '{"file_path": "/d", "text": "cut', True), ("Run", '{"file_path": "/e"}', False), ("Edit", "[1]", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, tool string, text string, cut boolean")
    df = df.select(F.lit("p").alias("path"), "seq", F.lit("tool_call").alias("kind"), F.lit(None).cast("string").alias("agent_id"), F.struct(F.col("text").alias("text"), F.col("tool").alias("tool_name"), F.col("cut").alias("truncated")).alias("payload"))
    assert {(r["file"], r["n"]) for r in counters.files_touched(df).collect()} == {("/a", 1), ("/b", 1), ("/c", 1), ("/d", 1)}
    assert [r[0] for r in df.orderBy("seq").select(counters.arg_hint()).collect()] == ["file_path=/a", "notebook_path=/b", "x=1", "", "file_path=/e", ""]


VERSIONS = "node_id string, version int, covered_lo long, created_at_seq long, supersedes string, dependencies array<string>"


def graph(spark):
    return spark.createDataFrame(
        [("a", 1, 0, 0, None, []), ("a", 2, 0, 5, "a@1", []), ("b", 1, 1, 1, None, ["a@1"]), ("c", 1, 2, 2, None, ["a"]), ("d", 1, 3, 3, None, ["b", "c"]), ("e", 1, 4, 4, None, ["a@2"]), ("f", 1, 5, 5, None, ["d@2"])],
        VERSIONS,
    )


def closure(spark, ref):
    return {r["ref"] for r in nodes.stale_closure(graph(spark), spark.createDataFrame([(ref,)], "ref string")).collect()}


def test_staleness(spark):
    assert closure(spark, "a@1") == {"b@1", "c@1", "d@1"} and closure(spark, "a@2") == {"c@1", "d@1", "e@1"} and closure(spark, "f@1") == set()
    versions = graph(spark)
    before = nodes.initial_validity(versions)
    assert {r["ref"]: r["validity"] for r in before.collect()}["a@1"] == "superseded"
    after = nodes.propagate(versions, before, spark.createDataFrame([("a@2",)], "ref string"), "invalidated")
    assert {r["ref"]: r["validity"] for r in after.collect()} == {"a@1": "superseded", "a@2": "invalidated", "b@1": "current", "c@1": "suspected_stale", "d@1": "suspected_stale", "e@1": "suspected_stale", "f@1": "current"}
    again = nodes.transition(after, spark.createDataFrame([("a@2", "current"), ("a@1", "suspected_stale"), ("b@1", "superseded")], "ref string, to string"))
    assert {r["ref"]: r["validity"] for r in again.collect()} == {"a@1": "superseded", "a@2": "invalidated", "b@1": "superseded", "c@1": "suspected_stale", "d@1": "suspected_stale", "e@1": "suspected_stale", "f@1": "current"}


def test_node_versions(spark):
    grown = nodes.evolve(graph(spark), spark.createDataFrame([("a", 9)], "node_id string, created_at_seq long"))
    head = {r["node_id"]: r for r in nodes.heads(grown).collect()}["a"]
    assert (head["version"], head["supersedes"], head["created_at_seq"]) == (3, "a@2", 9)
    assert nodes.chain_errors(grown).count() == 0 and [r["version"] for r in nodes.history(grown, "a").collect()] == [1, 2, 3]
    bad = spark.createDataFrame([("a", 1, 0, 0, "x@9", []), ("b", 2, 0, 0, None, []), ("c", 1, 0, 0, None, []), ("c", 3, 0, 0, "c@1", [])], VERSIONS)
    assert {(r["node_id"], r["version"]) for r in nodes.chain_errors(bad).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_grades(spark):
    rows = [
        ("exact_int", ["7"], "about 7 of 9", 1.0), ("exact_int", ["7"], "17", 0.0), ("exact_int", ["7"], "none", 0.0), ("exact_int", ["7"], None, 0.0),
        ("exact_str", ["A  b"], "it is a b.", 1.0), ("exact_str", ["ab"], "a b", 0.0),
        ("substring_of_truth", ["the quick brown foxes jumped"], "Quick brown birds", 1.0), ("substring_of_truth", ["the quick brown foxes jumped"], "no idea what", 0.0),
        ("set_f1", ["/a/x.py", "zz"], "x.py", pytest.approx(2 / 3)), ("set_f1", [], "None.", 1.0), ("set_f1", [], "x", 0.0), ("set_f1", ["a"], "none", 0.0), ("set_f1", ["a", "b"], "A; b\n", 1.0),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i long, kind string, truth array<string>, answer string")
    assert [r["score"] for r in evaluation.grade(df).orderBy("i").collect()] == [r[3] for r in rows]


def test_prefix_credit_and_repeats(spark):
    truth = spark.createDataFrame([("p", i, i * 10) for i in range(1, 5)], "path string, nth long, total long")
    answers = spark.createDataFrame([("p", 1, 10), ("p", 2, 20), ("p", 3, 99), ("p", 4, 40)], "path string, nth long, value long")
    assert contexts.prefix_credit(truth, answers).first()["credit"] == 0.5
    steps = spark.createDataFrame([("p", i, s, t) for i, (s, t) in enumerate([("a", True), ("a", False), ("b", False), ("a", False), ("done", False), ("done", False)])], "path string, seq long, signature string, transient boolean")
    assert [r["kind"] for r in contexts.action_repeats(steps).orderBy("seq").collect()] == ["new", "retry", "new", "repeat", "new", "new"]


def test_fidelity_notices_a_changed_recount(spark):
    a = spark.createDataFrame([("p", 1, 2), ("q", 3, 4)], "path string, x long, y long")
    b = spark.createDataFrame([("p", 1, 9), ("r", 3, 4)], "path string, x long, y long")
    assert {r["field"]: (r["equal"], r["total"]) for r in evaluation.fidelity(evaluation.compare(a, b)).collect()} == {"x": (1, 3), "y": (0, 3)}


def test_detectors_find_injected_pathologies(spark, tmp_path):
    scores = {r["kind"]: r for r in cli.detect_bench(spark, str(tmp_path / "traces"), n=16, seed=500).collect()}
    assert set(scores) == set(fixtures.PATHOLOGIES)
    for r in scores.values():
        assert r["recall"] >= 0.9 and r["fp"] == 0


def test_the_fold_agrees_with_the_raw_json(spark, tmp_path):
    scores = cli.fidelity_bench(spark, str(tmp_path / "traces"), n=4).collect()
    assert {r["field"] for r in scores} == set(recount.FIELDS) and all(r["equal"] == r["total"] == 8 for r in scores)


def test_recount_reads_and_parses_each_line_once(spark, tmp_path):
    """Several readings of the files took most of the time of comparing large folders."""
    (tmp_path / "s.jsonl").write_text('{"type": "user", "message": {"content": "go"}}\n[1]\n{"broken\n')
    (tmp_path / "none.jsonl").write_text("[1]\n")
    counted = recount.recount(transcripts.read_lines(spark, str(tmp_path)))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1 and plan.count("parseJson(") == 1
    assert [(r["path"].rsplit("/", 1)[1], r["n_turns"]) for r in counted.collect()] == [("s.jsonl", 1)]


def test_recount_of_odd_records(spark, tmp_path):
    rows = [
        {"type": "user", "message": {"content": [{"type": "text", "text": " <b>"}]}}, {"type": "user", "message": {"content": [{"type": "text", "text": "ask"}]}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}}, {"type": "user", "message": {"content": "direct"}, "toolUseResult": "r"}, {"type": "user", "isSidechain": True, "message": {"content": "aside"}},
        {"type": "assistant", "uuid": "a", "message": {"id": "m", "usage": {"input_tokens": 5, "output_tokens": None}, "content": [{"type": "tool_use", "id": "c", "name": "Edit", "input": {"file_path": "/f"}}, {"type": "tool_use", "id": "d", "name": "Run"}]}},
        {"type": "assistant", "uuid": "b", "message": {"id": "m", "usage": {"input_tokens": 5}, "content": "again"}}, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "is_error": True, "content": "no"}]}}, 7,
    ]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "{bad\n\n")
    lines = transcripts.read_lines(spark, str(tmp_path))
    got = recount.recount(lines).first().asDict()
    del got["path"]
    assert got == {"n_turns": 1, "n_tool_calls": 2, "n_tool_errors": 1, "input_tokens": 5, "output_tokens": 0, "cache_read_tokens": 0, "tools": "Edit=1\nRun=1", "files": "/f", "pending": "d"}
    assert recount.told(fold(transcripts.read_events(spark, str(tmp_path)))).drop("path").first().asDict() == got


def test_spans_and_detections_meet_in_blocks(spark, monkeypatch):
    """Against all pairs of a session, with blocks that spans cross."""
    rng = random.Random(4)
    monkeypatch.setattr(evaluation, "BLOCK", 8)
    spans = [("p", "k", lo, lo + rng.randint(0, 30)) for lo in rng.sample(range(200), 25)]
    fired = [("p", rng.choice("kj"), s, [rng.randint(0, 220) for _ in range(rng.randint(0, 3))]) for s in rng.sample(range(240), 30)]
    want = {(lo, hi, s) for _, kind, lo, hi in spans for _, k, s, ev in fired if k == kind and any(lo <= e <= hi + 6 for e in [*ev, s])}
    got = evaluation.matches(spark.createDataFrame(spans, "path string, kind string, lo long, hi long"), spark.createDataFrame(fired, "path string, kind string, detected_at_seq long, evidence array<long>"))
    assert sorted((r["lo"], r["hi"], r["detected_at_seq"]) for r in got.collect()) == sorted(want)


def test_spend_is_kept_over_restarts(spark, tmp_path):
    log = str(tmp_path / "spend.jsonl")
    extract.Spend(10.0, log).record("a", "m", 6.0, 5, 2)
    with open(log, "a") as f:
        f.write('{"cost_usd": 99')  # cut off by a crash
    again = extract.Spend(10.0, log)
    assert again.total_usd == 6.0
    again.record("b", "m", 4.5)
    with pytest.raises(extract.BudgetExceeded):
        extract.Spend(10.0, log).check()
    entries = extract.read_spend(spark, log)
    assert sorted((r["purpose"], r["cost_usd"]) for r in entries.collect()) == [("a", 6.0), ("b", 4.5)]
    assert evaluation.spend_check(entries, 10.0).first()["over"]


def test_scoreboard_keeps_other_scores(tmp_path):
    out = str(tmp_path / "b" / "scores.json")
    cli.scoreboard(out, "detect", [{"a": 1}])
    cli.scoreboard(out, "fidelity", [{"b": 2}])
    cli.scoreboard(out, "detect", [{"a": 3}])
    assert json.load(open(out)) == {"detect": [{"a": 3}], "fidelity": [{"b": 2}]}


def _reader(prompt):
    """Knows the number of turns where the flat log shows them, and nothing else."""
    context = prompt.split("\n\nQUESTIONS:")[0]
    return json.dumps({"n_turns": context.count(" user/message "), "top_tool": None})


def _broken(prompt):
    raise OSError("no connection")


def test_comprehension_of_conditions(spark, session):
    folder, trace = session
    path = str(folder / "one.jsonl")
    events = transcripts.read_events(spark, path).persist()
    scores = comprehension.comprehension(fold(events).persist(), events, transcripts.read_lines(spark, path), {"plain": _reader, "broken": _broken}).collect()
    turns = {r["condition"]: r["accuracy"] for r in scores if r["qid"] == "n_turns"}
    assert turns == {"flatlog": 0.5, "raw": 0.0, "view": 0.0}
    assert {r["n"] for r in scores if r["qid"] == "n_turns"} == {2} and len([r for r in scores if r["qid"] is None]) == 6


def test_comprehension_as_a_command(spark, session):
    folder, _ = session
    scores = cli.comprehend_bench(spark, str(folder / "one.jsonl"), ["plain=tests.test_operators:_reader", "broken=tests.test_operators:_broken"]).collect()
    assert {r["condition"]: r["accuracy"] for r in scores if r["qid"] == "n_turns"} == {"flatlog": 0.5, "raw": 0.0, "view": 0.0}


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("s")
    trace = fixtures.session_trace(2, 10)
    trace.say("<script>alert(1)</script>")
    (folder / "one.jsonl").write_text(trace.lines())
    (folder / "bad.jsonl").write_text("{no\n")
    return folder, trace


def test_text_view_and_page(spark, session):
    folder, trace = session
    state = fold(transcripts.read_events(spark, str(folder / "one.jsonl"))).persist()
    view = views.text_view(state).first()["view"]
    assert view.startswith("# Run model · session session-") and len(view) < 20_000
    assert f"COUNTERS: turns={trace.truth['turns']} tool_calls={trace.truth['calls']} errors={trace.truth['errors']} " in view
    assert "## Episodes (chronological)" in view and "[aggregate] total:" in view
    page = views.page(state.first(), view, 1)
    assert "<script>" not in page and "&lt;script&gt;" in page and 'content="2"' in page
    events = transcripts.read_events(spark, str(folder / "one.jsonl"))
    asked = {r["qid"]: r for r in views.questions(state, events).collect()}
    assert asked["n_turns"]["truth"] == [str(trace.truth["turns"])] and asked["last_error"]["truth"] == ["the sheet is locked"] and asked["dangling"]["truth"] == ["Weigh"] * bool(trace.truth["open_at_end"] + trace.truth["interrupted"])
    told = {r["condition"]: r["context"] for r in views.conditions(state, events, transcripts.read_lines(spark, str(folder / "one.jsonl"))).collect()}
    assert told["view"] == view and told["raw"] == trace.lines()[:-1] and told["flatlog"].startswith("[0] user/message  Request 0")


def test_commands(spark, session, tmp_path):
    folder, _ = session
    assert os.path.getsize(cli.render(spark, str(folder / "one.jsonl"), str(tmp_path / "p.html"))) > 500
    cli.watch(spark, str(folder / "one.jsonl"), str(tmp_path / "w.html"), once=True).awaitTermination()
    assert 'http-equiv="refresh"' in (tmp_path / "w.html").read_text()
    rows = {r["path"].split("/")[-1]: r for r in cli.fleet(spark, str(folder), out=str(tmp_path / "fleet")).collect()}
    assert rows["one.jsonl"]["outcome"] == "ok" and rows["bad.jsonl"]["outcome"].startswith("parse-error")
    page = (tmp_path / "fleet" / rows["one.jsonl"]["page"]).read_text()
    assert "COUNTERS: " in page and rows["one.jsonl"]["page"] in (tmp_path / "fleet" / "index.html").read_text() and rows["one.jsonl"]["ask"]
    assert rows["one.jsonl"]["live"] and "live" in (tmp_path / "fleet" / "index.html").read_text()
    os.utime(folder / "bad.jsonl", (1e9, 1e9))
    assert [(r["path"].split("/")[-1], r["live"]) for r in cli.fleet(spark, str(folder), most=1, out=str(tmp_path / "fleet")).collect()] == [("one.jsonl", True)]


def test_extractor_halves_refused_batches_and_verifies(spark, session):
    folder, _ = session
    events = transcripts.read_events(spark, str(folder / "one.jsonl")).persist()
    texts = [r["text"] for r in extract.observations(events).orderBy("seq").collect()]
    asked = []

    def client(prompt):
        asked.append(prompt)
        observed = prompt.split("OBSERVATIONS:\n")[1].removesuffix("\n\nJSON:").split("\n\n")
        if len(observed) > 2:
            return ""
        return "Sure: " + str([{"i": i, "facts": [{"key": "total", "value": o.split("total = ")[1].split("\n")[0]}, {"key": "made", "value": "up-value"}]} for i, o in enumerate(observed)]).replace("'", '"')

    machine = extract.Extractor(client)
    memo = extract.harvest(events, machine).persist()
    found = memo.where("key is not null").collect()
    assert len(found) == len(texts) and all(f["key"] == "total" and any(f"total = {f['value']}" in t for t in texts) for f in found)
    assert machine.stats["refusals"] > 0 and machine.stats["rejected"] == len(texts) and all(f["source"].startswith("/stock/") for f in found)
    before = len(asked)
    assert extract.harvest(events, machine, memo).count() == memo.count() and len(asked) == before


def test_refused_single_goes_to_the_fallback_and_budget_stops():
    machine = extract.Extractor(lambda p: "", fallback=lambda p: '[{"i": 0, "facts": [{"key": "k", "value": "V1"}]}]')
    assert machine.facts(["has v1"]) == [[("k", "V1")]] and machine.stats["fallbacks"] == 1
    assert extract.Extractor(lambda p: "").facts(["x"]) == [[]]
    machine.spend.record("test", "m", 5000.0)
    with pytest.raises(extract.BudgetExceeded):
        machine.facts(["y"])
    assert extract.parse_answer("no json") == extract.parse_answer("[{]") == {}
