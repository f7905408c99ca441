import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from runloom.operators import counters
from runloom.operators.fold import fold
from runloom.schema import INLINE_CAP
from runloom.sources import fixtures, transcripts


def rec(kind, **body):
    return json.dumps({"type": kind, "uuid": body.pop("uuid", "u"), "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", **body}, ensure_ascii=False)


def decoded(line, path="/x/file.jsonl", no=3):
    return transcripts.decode_line(path, no, 10, line if isinstance(line, bytes) else line.encode())


def agent(content, **kw):
    return rec("assistant", message={"role": "assistant", "id": "m1", "model": "test-premium", "usage": {"input_tokens": 5, "output_tokens": None}, "content": content}, **kw)


def test_blocks_of_an_agent_record():
    rows = decoded(agent([{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c1", "name": "Read", "input": {"z": 1, "a": "é"}}, {"type": "text", "text": "hi"}, "bare"]))
    assert [(r["kind"], r["text"], r["block_index"]) for r in rows] == [("thinking", "hm", 0), ("tool_call", '{"z": 1, "a": "é"}', 1), ("message", "hi", 2), ("message", "bare", 3)]
    assert rows[0]["usage"]["input_tokens"] == 5 and rows[0]["usage"]["output_tokens"] == 0 and rows[1]["usage"] is None
    assert rows[1]["correlation_id"] == "c1" and {r["api_message_id"] for r in rows} == {"m1"}


@pytest.mark.parametrize(("content", "text"), [([], ""), ("plain", "plain"), (None, "")])
def test_agent_content_without_blocks(content, text):
    (row,) = decoded(agent(content))
    assert (row["kind"], row["text"]) == ("message", text)


def test_kinds_of_other_records():
    of = lambda line: [(r["kind"], r["source"], r["text"], r["tool_name"]) for r in decoded(line)]
    assert of(rec("user", isMeta=True, message={"content": "x" * 600})) == [("session_meta", "meta", "x" * 500, "isMeta")]
    assert of(rec("user", message={"content": "ask"})) == [("message", "user", "ask", None)]
    assert of(rec("user", message={"content": "t"}, toolUseResult={"b": 1, "a": 2}, sourceToolUseID="c")) == [("tool_result", "tool", '{"b": 1, "a": 2}', None)]
    assert of(rec("summary", summary="all")) == [("compaction", "system", "all", None)]
    assert of(rec("attachment", attachment={"k": 1})) == [("attachment", "system", '{"k": 1}', None)]
    assert of(rec("ai-title", aiTitle="t"))[0][0::3] == ("session_meta", "ai-title")
    assert of(rec("future-thing"))[0][0::3] == ("unknown", "future-thing")
    assert of(agent([{"type": "text", "text": "503"}], isApiErrorMessage=True))[0][0] == "error"


def test_results_count_only_results():
    line = rec("user", message={"content": [{"type": "text", "text": "dropped"}, {"type": "tool_result", "tool_use_id": "a", "content": [{"type": "text", "text": "x"}, {"type": "image", "n": 1}]}, {"type": "tool_result", "tool_use_id": "b", "content": "y", "is_error": "false"}]})
    rows = decoded(line)
    assert [(r["block_index"], r["correlation_id"], r["text"], r["is_error"]) for r in rows] == [(0, "a", 'x\n{"type": "image", "n": 1}', False), (1, "b", "y", True)]


def test_outcomes_of_odd_lines():
    assert [decoded(x)[0]["outcome"] for x in (b"  ", b"{this is not json", b"[1,2]", b'{"type":"user","message":"no object"}', b"\xff\xfe", b'{"type":"assistant","message":{"content":[{"type":"tool_use","id":7}]}}')] == [
        "blank", "malformed", "malformed", "rejected", "malformed", "rejected",
    ]
    (row,) = decoded(b'{"type":"user","message":{"content":"q"},"timestamp":"2026-08-17T10:00:05","isSidechain":true}')
    assert row["record_id"] == "file:3" and row["session_id"] == "unknown" and row["agent_id"] == "sidechain" and row["ts"].isoformat().startswith("2026-08-17T10:00:05")
    assert decoded(b'{"type":"user","timestamp":"nonsense"}')[0]["ts"] is None
    assert decoded(b'{"type":"user","type":"summary","summary":"last wins"}')[0]["kind"] == "compaction"


def test_payload_is_capped_but_hashed_whole(spark, tmp_path):
    import hashlib

    texts = ["é" * INLINE_CAP, "é" * (INLINE_CAP + 1)]
    (tmp_path / "a.jsonl").write_text("".join(rec("user", message={"content": t}) + "\n" for t in texts))
    rows = transcripts.read_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(len(r["payload"]["text"]), r["payload"]["truncated"], r["payload"]["char_len"]) for r in rows] == [(4000, False, 4000), (4000, True, 4001)]
    assert [r["payload"]["sha256"] for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_partial_last_line_and_stats(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(f"{rec('user', message={'content': 'q'})}\r\n\n{{bad\n{rec('odd')}\n{rec('user')[:9]}".encode())
    lines = transcripts.read_lines(spark, str(tmp_path))
    stats = transcripts.parse_stats(lines, transcripts.decode(lines)).first()
    assert (stats["lines"], stats["events"], stats["malformed"], stats["trailing_partial_bytes"]) == (4, 2, 1, 9)
    assert [(r["type"], r["n"]) for r in transcripts.unknown_types(transcripts.decode(lines)).collect()] == [("odd", 1)]
    events = transcripts.read_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["raw"]["line_no"]) for r in events] == [(0, 1), (1, 4)]


def whole_lines(data):
    """(byte_offset, raw) of the finished lines."""
    at, out = 0, []
    for raw in data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]]:
        if raw.endswith(b"\n"):
            out.append((at, raw[:-1]))
        at += len(raw)
    return out


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10_000), max_size=4), st.sampled_from([7, 100, 997, 1 << 20]))
def test_cut_at_any_bytes_reads_the_same_lines(tmp_path, cuts, split):
    """Files that grow by any bytes, read in ranges of any size: each finished line once, in its batch."""
    data = fixtures.session_trace(3, 3).lines().encode()[:10_000] + b"\n\xff{\n\nlast without end"
    path = tmp_path / "t.jsonl"
    path.write_bytes(b"")
    reader, seen, offset = transcripts._TailReader({"path": str(path), "split": str(split)}), [], {}
    for cut in sorted(c % (len(data) + 1) for c in cuts) + [len(data)]:
        path.write_bytes(data[:cut])
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(offset, end) for r in reader.read(p)]
        assert rows == [r for p in reader.partitions(offset, end) for r in reader.read(p)]
        seen, offset = seen + rows, end
        assert [(r[3], r[4]) for r in seen] == [(at, raw) for at, raw in whole_lines(data[:cut] + b"") if at + len(raw) < cut]
    batch = transcripts._BatchReader({"path": str(path), "split": str(split)})
    rows = [r for p in batch.partitions() for r in batch.read(p)]
    assert [(r[3], r[4]) for r in rows if r[5]] == whole_lines(data) and [r[4] for r in rows if not r[5]] == [b"last without end"]


def test_line_numbers_of_files_of_many_ranges(spark, tmp_path):
    data = fixtures.session_trace(4, 5).lines().encode()
    (tmp_path / "large.jsonl").write_bytes(data + b"rest")
    (tmp_path / "small.jsonl").write_bytes(b"{}\n{}\n")
    (tmp_path / "none.jsonl").write_bytes(b"")
    got = {(r["path"].split("/")[-1], r["line_no"]): (r["byte_offset"], bytes(r["raw"]), r["complete"]) for r in transcripts.read_lines(spark, str(tmp_path), split=333).collect()}
    want = {("large.jsonl", i): (at, raw, True) for i, (at, raw) in enumerate(whole_lines(data), 1)}
    want |= {("large.jsonl", len(want) + 1): (len(data), b"rest", False), ("small.jsonl", 1): (0, b"{}", True), ("small.jsonl", 2): (3, b"{}", True)}
    assert got == want


def test_small_files_share_a_task_and_large_ones_are_cut():
    cut = transcripts.pieces([("a", 0, 10), ("b", 0, 10), ("c", 5, 130), ("d", 3, 3)], 50)
    assert [p.ranges for p in cut] == [[("a", 0, 0, 10), ("b", 0, 0, 10)], [("c", 0, 5, 55)], [("c", 1, 55, 105)], [("c", 2, 105, 130)]]


def test_a_batch_of_a_stream_can_be_bounded(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"x\n" * 100)
    reader = transcripts.TranscriptSource({"path": str(tmp_path), "maxBytes": "30"}).streamReader(None)
    offset, seen = {str(tmp_path / "a.jsonl"): 0}, 0
    reader.partitions({}, offset)
    while offset != (end := reader.latestOffset()):
        rows = [r for p in reader.partitions(offset, end) for r in reader.read(p)]
        assert 0 < len(rows) <= 15
        seen, offset = seen + len(rows), end
    assert seen == 100


def test_generated_truth(spark, tmp_path):
    traces = [fixtures.session_trace(i) for i in range(4)]
    for t in traces:
        (tmp_path / f"{t.session}.jsonl").write_text(t.lines())
    events = transcripts.read_events(spark, str(tmp_path)).persist()
    got = {r["path"].split("/")[-1][:-6]: r for r in counters.session_counters(events).collect()}
    states = {r["path"].split("/")[-1][:-6]: r for r in fold(events).collect()}
    for t in traces:
        assert (got[t.session]["n_turns"], got[t.session]["n_tool_calls"], got[t.session]["n_tool_errors"]) == (t.truth["turns"], t.truth["calls"], t.truth["errors"])
        last = {v["node_id"]: v["status"] for v in states[t.session]["versions"]}
        assert list(last.values()).count("interrupted") == t.truth["interrupted"] and list(last.values()).count("unresolved") == t.truth["open_at_end"]


def test_snapshot(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text(fixtures.session_trace(1).lines())
    events = transcripts.read_events(spark, str(tmp_path / "t.jsonl"))
    lines = transcripts.read_lines(spark, str(tmp_path / "t.jsonl"))
    marks = transcripts.marks(lines, transcripts.decode(lines))
    transcripts.write_snapshot(events, str(tmp_path / "snap"), marks)
    back = transcripts.load_snapshot(spark, str(tmp_path / "snap"))
    assert back.columns == events.columns and sorted(map(str, back.collect())) == sorted(map(str, events.collect()))
    mark = spark.read.parquet(str(tmp_path / "snap" / "marks")).first()
    assert mark["durable_offset"] == (tmp_path / "t.jsonl").stat().st_size and mark["observed_seq"] == events.count() - 1
    with open(tmp_path / "t.jsonl", "a") as f:
        f.write(fixtures.session_trace(2).lines())
    offsets = transcripts.resume_offsets(spark.read.parquet(str(tmp_path / "snap" / "marks")))
    reader = transcripts._TailReader({"path": str(tmp_path / "t.jsonl"), "offsets": offsets})
    rows = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for r in reader.read(p)]
    assert rows[0][3] == mark["durable_offset"] and len(rows) == len(fixtures.session_trace(2).records)


def test_lines_go_to_spark_and_to_decoding_in_batches(tmp_path):
    """One by one, they take longer than all else; wrong values reject their own lines only, wherever they stand."""
    rows = [("/x/f.jsonl", 0, i + 1, i, b"y" * (i % 50), True) for i in range(1000)]
    batches = list(transcripts.in_columns(iter(rows), 64, 1000))
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows and all(b.num_rows <= 64 for b in batches) and len(batches) < 60
    good, wrong = agent("ask").encode(), agent([{"type": "tool_use", "id": 7}]).encode()
    lines = [wrong if i in (0, 70, 71, 199) else b"{" if i == 50 else good for i in range(200)]
    made = list(transcripts._in_columns([transcripts._line_rows("/x/f.jsonl", i, i, x) for i, x in enumerate(lines)]))
    assert [r for b in made for r in b.to_pylist()] == [r for i, x in enumerate(lines) for r in transcripts.decode_line("/x/f.jsonl", i, i, x)]
    assert len(made) < 50 and len(list(transcripts._in_columns([transcripts._line_rows("/x/f.jsonl", i, i, good) for i in range(200)]))) == 1


def test_a_reader_that_goes_to_every_task_has_no_list_of_files(tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.jsonl").write_bytes(b"{}\n")
    reader = transcripts._BatchReader({"path": str(tmp_path)})
    assert len(list(reader.read(reader.partitions()[0]))) == 300 and all(len(str(v)) < 1000 for v in vars(reader).values())


def test_many_session_files_are_listed_by_few_tasks_and_all_of_them_without_an_order(spark, tmp_path):
    (tmp_path / "subagents").mkdir()
    for i in range(800):
        (tmp_path / f"s{i}.jsonl").write_bytes(b"\n" * (i % 3 + 1))
    (tmp_path / "subagents" / "a.jsonl").write_bytes(b"\n")
    found = transcripts.list_sessions(spark, str(tmp_path), None)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((os.path.basename(r["path"]), r["length"]) for r in found.collect()) == sorted((f"s{i}.jsonl", i % 3 + 1) for i in range(800))
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    assert transcripts.list_sessions(spark, str(tmp_path)).count() == 15
