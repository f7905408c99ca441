"""Views of folded sessions: compact text, a static page, an index of many sessions, questions with known answers."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from runloom.functions import expressions as X
from runloom.session import small_batches

SHOWN_FAILURES, SHOWN_TOOLS, LEAST_SUMMED = 5, 8, 3

#: The lines of the text view.
LINES = {
    "head": "# Run model · session {id}",
    "goal": "GOAL: {goal}",
    "request": "LATEST USER REQUEST: {request}",
    "now": "NOW: {now}",
    "flight": "IN FLIGHT: {calls}",
    "anomaly": "ANOMALY[{severity}] {kind}: {message}",
    "counters": "COUNTERS: turns={turns} tool_calls={calls} errors={errors} est_cost=${cost:.2f} tokens(out={out}, cache_read={cached})",
    "tools": "TOP TOOLS: {tools}",
    "files": "FILES TOUCHED: {files}",
    "facts": "KEY FACTS ({live} in view of {all} extracted — grouped by key; evicted values fold into [aggregate] lines):",
    "fact": "  {key} = {value}",
    "sum": "  [aggregate] {base}: {n} values total ({folded} folded out of view), sum = {total} — ALREADY INCLUDES every {base} above and every folded one, through {through}",
    "failures": "RECENT FAILURES:",
    "failure": "  - {text}",
    "episodes": "## Episodes (chronological)",
    "episode": "- [{status}] {ask}",
    "content": "    {content}",
}


def _groups() -> F.Column:
    """array<struct<base, n, folded, total, through>> of the groups of a state's live facts that are all whole numbers, by base,
    with what was evicted. A state has at most MAX_FACTS facts, so no group leaves its row."""
    zero = F.lit(0).cast("decimal(38,0)")
    named = F.transform("facts", lambda f: F.struct(X.base_key(f["key"]).alias("base"), f["key"].alias("key"), X.whole_number(f["value"]).alias("number")))

    def group(base: F.Column) -> F.Column:
        live = F.filter(named, lambda f: f["base"] == base)
        gone = F.get(F.filter("aggregates", lambda a: a["base"] == base), F.lit(0))
        total = F.aggregate(live, zero, lambda a, f: (a + F.coalesce(f["number"], zero)).cast("decimal(38,0)")) + F.coalesce(gone["total"].cast("decimal(38,0)"), zero)
        n, folded = F.size(live).cast("long"), F.coalesce(gone["n"], F.lit(0).cast("long"))
        return F.struct(
            base.alias("base"), (n + folded).alias("n"), folded.alias("folded"), total.cast("decimal(38,0)").cast("string").alias("total"),
            F.element_at(live, -1)["key"].alias("through"), F.forall(live, lambda f: f["number"].isNotNull()).alias("whole"),
        )

    bases = F.array_sort(F.array_distinct(F.transform(named, lambda f: f["base"])))
    return F.filter(F.transform(bases, group), lambda g: g["whole"] & (g["n"] >= LEAST_SUMMED))


def fact_groups(state: DataFrame) -> DataFrame:
    """(path, base, n, folded, total, through) of the groups of live facts that are all whole numbers, with what was evicted."""
    return state.select("path", F.explode(_groups()).alias("g")).select("path", "g.base", "g.n", "g.folded", "g.total", "g.through")


def _say(name: str, **values: F.Column) -> F.Column:
    """LINES[name] with columns in its places."""
    import string

    parts = []
    for text, field, spec, _ in string.Formatter().parse(LINES[name]):
        parts.append(F.lit(text))
        if field:
            parts.append(F.format_string("%.2f", values[field]) if spec else values[field].cast("string"))
    return F.concat(*parts)


def text_view(state: DataFrame) -> DataFrame:
    """(path, view): the compact text of each session, put together natively and row by row: nothing is shuffled."""
    empty = F.array().cast("array<string>")
    when = lambda c, x: F.when(c, x).otherwise(empty)
    top = F.slice(F.array_sort(F.col("tools"), lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).otherwise(F.array_position("tools", a).cast("int") - F.array_position("tools", b).cast("int"))), 1, SHOWN_TOOLS)
    tools = F.array_join(F.transform(top, lambda t: F.concat(t["name"], F.lit("×"), t["n"].cast("string"))), ", ")
    by_base = F.array_sort(F.transform("facts", lambda f: F.struct(X.base_key(f["key"]).alias("base"), f["key"].alias("key"), f["value"].alias("value"))))
    folded = F.aggregate("aggregates", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    fact_lines = F.concat(F.array(_say("facts", live=F.size("facts"), all=F.size("facts") + folded)), F.transform(by_base, lambda f: _say("fact", key=f["key"], value=f["value"])))
    sums = F.transform(_groups(), lambda g: _say("sum", base=g["base"], n=g["n"], folded=g["folded"], total=g["total"], through=g["through"]))
    failures = F.slice(F.col("recent_failures"), F.greatest(F.size("recent_failures") - SHOWN_FAILURES + 1, F.lit(1)), SHOWN_FAILURES)
    active = F.filter("anomalies", lambda a: a["cleared_at_seq"].isNull())
    told = F.transform("episodes", lambda e: F.concat(_say("episode", status=e["status"], ask=F.substring(e["ask"], 1, 120)), F.lit("\n"), _say("content", content=e["content"])))
    lines = F.concat(
        F.array(
            _say("head", id=F.substring("session_id", 1, 8)),
            _say("goal", goal=F.coalesce("goal_text", F.lit("(unknown)"))),
            _say("request", request=F.coalesce("latest_user_directive", F.lit("(none)"))),
            _say("now", now=F.coalesce("frontier", F.lit("(idle)"))),
        ),
        when(F.size("pending") > 0, F.array(_say("flight", calls=F.array_join(F.transform("pending", lambda c: F.concat(c["tool_name"], F.lit("("), c["correlation_id"], F.lit(")"))), ", ")))),
        F.transform(active, lambda a: _say("anomaly", severity=a["severity"], kind=a["kind"], message=a["message"])),
        F.array(
            _say("counters", turns=F.col("n_turns"), calls=F.col("n_tool_calls"), errors=F.col("n_tool_errors"), cost=F.col("cost_usd"), out=F.col("tokens")[1], cached=F.col("tokens")[2]),
            _say("tools", tools=F.when(F.size("tools") > 0, tools).otherwise("(none)")),
        ),
        when(F.size("files") > 0, F.array(_say("files", files=F.array_join(F.array_sort(F.transform("files", lambda f: f["name"])), ", ")))),
        when(F.size("facts") > 0, F.concat(fact_lines, sums)),
        when(F.size("recent_failures") > 0, F.concat(F.array(F.lit(LINES["failures"])), F.transform(failures, lambda x: _say("failure", text=x)))),
        F.array(F.lit(""), F.lit(LINES["episodes"])),
        told,
    )
    return state.select("path", F.array_join(lines, "\n").alias("view"))


def page(state: Row, view: str, refresh_s: float | None = None) -> str:
    """A static page of one session (one row of STATE and its text view), everything escaped."""
    e = lambda x: html.escape(str(x if x is not None else ""))
    meta = f'<meta http-equiv="refresh" content="{max(2, round(refresh_s))}">' if refresh_s else ""
    alarms = "".join(f"<li class={e(a['severity'])}>{e(a['kind'])}: {e(a['message'])} (from {a['detected_at_seq']}{'' if a['cleared_at_seq'] is None else f' to {a["cleared_at_seq"]}'})</li>" for a in state["anomalies"])
    rows = lambda versions: "".join(f"<tr><td>{e(v['node_id'])}@{v['version']}</td><td>{e(v['status'])}</td><td>{e(v['title'])}</td><td>{e(v['content'])}</td><td>{e(v['producer'])}</td></tr>" for v in versions)
    return (
        f'<!DOCTYPE html><html><head><meta charset="utf-8">{meta}<title>{e(state["session_id"])}</title></head><body>'
        f"<p>Observed up to event {state['observed_seq']}.</p><pre>{e(view)}</pre><h2>Anomalies</h2><ul>{alarms}</ul><h2>Episodes</h2><table>{rows(state['episodes'])}</table><h2>Versions</h2><table>{rows(state['versions'])}</table></body></html>"
    )


def pages(state: DataFrame) -> DataFrame:
    """(path, content): the static page of each session, made where its row is."""
    shown = small_batches(state.join(text_view(state), "path"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"path": [r["path"] for r in rows], "content": [page(r, r["view"]) for r in rows]}, schema=pa.schema([("path", pa.string()), ("content", pa.string())]))

    return shown.mapInArrow(each, "path string, content string")


def page_name(path: F.Column) -> F.Column:
    """The end of the folder's name and the file's, which tell sessions of one fleet apart."""
    parts = F.split(path, "/")
    folder = F.right(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), F.lit(40))
    plain = F.regexp_replace(F.concat(folder, F.lit("__"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")), r"[^\w.=-]", "-")
    return F.concat(F.regexp_replace(plain, "^[._]+", ""), F.lit(".html"))


def fleet(state: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """A row for each session; failed(path, reason) are sessions that could not be read."""
    active = F.array_sort(F.transform(F.filter("anomalies", lambda a: a["cleared_at_seq"].isNull()), lambda a: a["kind"]))
    ask = F.substring(F.coalesce("latest_user_directive", "goal_text", F.lit("")), 1, 140)
    good = state.select(
        "path", "session_id", F.lit("ok").alias("outcome"), "n_turns", "n_tool_calls", "n_tool_errors", "cost_usd", F.size(active).cast("long").alias("active_anomalies"),
        F.array_join(active, ", ").alias("anomalies"), ask.alias("ask"), "goal_text", page_name(F.col("path")).alias("page"),
    )
    if failed is None:
        return good
    return good.unionByName(failed.select("path", F.concat(F.lit("parse-error: "), F.col("reason")).alias("outcome")), allowMissingColumns=True)


def fleet_page(rows: list[Row]) -> str:
    """An index of sessions, each with a link to its page where it has one."""
    names = [n for n in (rows[0].__fields__ if rows else []) if n != "page"]
    shown = lambda r, n: html.escape(str("" if r[n] is None else r[n]))
    link = lambda r, n: f'<a href="{html.escape(r["page"])}">{shown(r, n)}</a>' if n == "path" and "page" in r and r["page"] else shown(r, n)
    cells = "".join("<tr>" + "".join(f"<td>{link(r, n)}</td>" for n in names) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><html><body><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>{cells}</table></body></html>"


def questions(state: DataFrame, events: DataFrame) -> DataFrame:
    """(path, qid, kind, ask, truth array<string>): up to six questions about a session whose answers its state and events have."""
    bad = X.is_result() & X.failed()
    last = events.groupBy("path").agg(F.max_by(F.when(bad, F.substring(X.text(), 1, 300)), F.when(bad, F.col("seq"))).alias("last_error"))
    top = F.array_max(F.transform("tools", lambda t, i: F.struct(t["n"].alias("n"), (-i).alias("i"), t["name"].alias("name"))))["name"]
    always = F.lit(True)
    asked = [
        ("latest_ask", "substring_of_truth", "What did the user ask for last?", F.array("latest_user_directive"), F.col("latest_user_directive").isNotNull()),
        ("n_turns", "exact_int", "How many user turns were there? A whole number.", F.array(F.col("n_turns").cast("string")), always),
        ("top_tool", "exact_str", "Which tool was called most often?", F.array(top), F.size("tools") > 0),
        ("files", "set_f1", "Which files were read or changed? One path a line.", F.array_sort(F.transform("files", lambda f: f["name"])), F.size("files") > 0),
        ("last_error", "substring_of_truth", "What did the last tool error say?", F.array("last_error"), F.col("last_error").isNotNull()),
        ("dangling", "set_f1_or_none", "Which tools are still to return? Names, or none.", F.array_sort(F.array_distinct(F.transform("pending", lambda c: c["tool_name"]))), always),
    ]
    one = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(k).alias("kind"), F.lit(ask).alias("ask"), t.alias("truth"), ok.alias("ok")) for q, k, ask, t, ok in asked])
    rows = state.join(last, "path", "left").select("path", F.explode(one).alias("q")).where("q.ok")
    return rows.select("path", "q.qid", "q.kind", "q.ask", "q.truth")


def conditions(state: DataFrame, events: DataFrame, lines: DataFrame, most: int = 100_000) -> DataFrame:
    """(path, condition, context): what a reader is shown of each session: the tail of its raw lines, of its flat log, or its view.

    lines(path, line_no, raw, complete) are those of sources.transcripts. Of a log, only the lines of its tail are put together.
    """
    from runloom.operators.contexts import flat_log, tail

    raw = tail(lines.where("complete").select("path", "line_no", F.col("raw").cast("string").alias("line")), "line_no", "line", most)
    flat = tail(flat_log(events), "seq", "line", most)
    shown = [("raw", raw), ("flatlog", flat), ("view", text_view(state).select("path", F.col("view").alias("context")))]
    out = None
    for name, rows in shown:
        one = rows.select("path", F.lit(name).alias("condition"), "context")
        out = one if out is None else out.unionByName(one)
    return out
