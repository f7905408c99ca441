"""Commands: render, watch, sessions, fleet, bench. `python -m runloom.cli <command> --help` tells more."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators import comprehension, evaluation, recount, views
from runloom.operators.fold import Limits, anomalies, fold
from runloom.session import build_session, scratch_path
from runloom.sources import fixtures, sinks, transcripts
from runloom.streaming.live import current, follow, keep, kept_changes


def _write(path: str, text: str) -> None:
    """Replace a file at once."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.new", path)


def render(spark: SparkSession, session: str, out: str | None = None) -> str:
    out = out or os.path.splitext(os.path.basename(session))[0] + ".html"
    state = fold(transcripts.read_events(spark, session)).persist()
    row = state.first()
    if row is None:
        raise SystemExit(f"{session}: no events")
    _write(out, views.page(row, views.text_view(state).first()["view"]))
    return out


def watch(spark: SparkSession, session: str, out: str, poll: float = 2.0, once: bool = False, checkpoint: str | None = None):
    """Renew a page while a session grows.

    Where it stands, and the log of its changes, are kept under `checkpoint` (in the session's shared folder by a name that
    follows from the page's; on one host without such a folder, beside the page), so a restart goes on from there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    beside = f"{shared.rstrip('/')}/watch-{os.path.abspath(out).strip('/').replace('/', '-')}" if shared else f"{os.path.abspath(out)}.checkpoint"
    folder = checkpoint or beside
    log = f"{folder}-changes"

    def show(changes: DataFrame, batch: int) -> None:
        keep(log)(changes, batch)
        states = current(kept_changes(spark, log)).persist()
        row = states.first()
        if row is not None:
            _write(out, views.page(row, views.text_view(states).first()["view"], refresh_s=poll))
        states.unpersist()

    return follow(spark, session, folder, show, every=None if once else f"{poll} seconds")


#: Seconds since its last change for which a session counts as live.
LIVE_S = 300


def fleet(spark: SparkSession, path: str, most: int = 25, out: str = "fleet") -> DataFrame:
    """The index of the latest sessions, the live ones marked, and a page for each of them, which tasks write.

    One that cannot be read is a row that says so. Only the files of these sessions are read."""
    listed = transcripts.list_sessions(spark, path, most).select("path", F.col("modificationTime").cast("double").alias("changed"), F.col("length").alias("bytes")).collect()
    known = {r["path"].removeprefix("file:"): (r["changed"], r["bytes"]) for r in listed}
    decoded = transcripts.decode(transcripts.read_lines(spark, list(known))).persist()
    state = fold(transcripts.to_events(decoded)).persist()
    good = decoded.groupBy("path").agg(F.count_if(F.col("outcome") == "event").alias("n")).where("n > 0").select("path")
    now = time.time()
    named = spark.createDataFrame([(p, now - t < LIVE_S, round((now - t) / 60, 1), n) for p, (t, n) in known.items()], "path string, live boolean, age_minutes double, bytes long")
    failed = named.select("path").join(good, "path", "left_anti").select("path", F.lit("no events").alias("reason"))
    rows = views.fleet(state, failed).join(named, "path").orderBy("path")
    sinks.write_committed(views.pages(state).select(views.page_name(F.col("path")).alias("name"), "content"), out)
    _write(os.path.join(out, "index.html"), views.fleet_page(rows.collect()))
    return rows


def write_traces(spark: SparkSession, folder: str, traces: list[fixtures.Trace]) -> None:
    """One file for each generated trace, in a folder named after its session, written by Spark to any file system."""
    rows = spark.createDataFrame([(t.session, i, line) for t in traces for i, line in enumerate(t.lines().splitlines())], "session string, n int, value string")
    rows.repartition("session").sortWithinPartitions("session", "n").drop("n").write.partitionBy("session").text(folder)


def _session(path: F.Column) -> F.Column:
    return F.regexp_extract(path, "session=([^/]+)/", 1)


def detect_bench(spark: SparkSession, folder: str, n: int = 30, seed: int = 100, limits: Limits | None = None) -> DataFrame:
    """Scores of the detectors on generated traces with labelled pathologies, a fifth of them without any."""
    traces = []
    for i in range(n):
        kinds = [fixtures.PATHOLOGIES[(i + j) % 4] for j in range(i % 3 + 1)] if i % 5 else []
        traces.append(fixtures.pathology_trace(seed + i, kinds))
    write_traces(spark, folder, traces)
    events = transcripts.read_events(spark, folder).persist()
    labels = spark.createDataFrame([(t.session, *label) for t in traces for label in t.labels], "session string, kind string, start_line long, end_line long")
    paths = events.select("path").distinct().select("path", _session(F.col("path")).alias("session"))
    spans = evaluation.label_spans(labels.join(F.broadcast(labels.select("session").distinct().join(paths, "session")), "session").drop("session"), events)
    found = anomalies(fold(events, limits)).where(F.col("kind").isin(*fixtures.PATHOLOGIES))
    return evaluation.detection_scores(spans, found)


def compare_with_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(field, equal, total): of how many transcripts the fold's state says what a recount of the raw JSON does."""
    lines = transcripts.read_lines(spark, path)
    state = fold(transcripts.to_events(transcripts.decode(lines)))
    return evaluation.fidelity(evaluation.compare(recount.told(state), recount.recount(lines)))


def fidelity_bench(spark: SparkSession, folder: str, n: int = 8, seed: int = 700, more: str | None = None) -> DataFrame:
    """The comparison over generated traces of both kinds, and over the files of one's own under `more`."""
    write_traces(spark, folder, [fixtures.session_trace(seed + i) for i in range(n)] + [fixtures.pathology_trace(seed + i, list(fixtures.PATHOLOGIES[: i % 5])) for i in range(n)])
    return compare_with_raw(spark, [folder, more] if more else folder)


def scoreboard(out: str, key: str, rows: list[dict]) -> None:
    """Put rows under a key of the scoreboard, whose other keys stay."""
    board = {}
    if os.path.exists(out):
        with open(out, encoding="utf-8") as f:
            board = json.load(f)
    _write(out, json.dumps(board | {key: rows}, indent=1))


def comprehend_bench(spark: SparkSession, folder: str, readers: list[str]) -> DataFrame:
    """Mean grades of readers (name=module:function, a function of a prompt) who are shown the transcripts under a folder in each way."""
    panel = {}
    for named in readers:
        name, _, place = named.partition("=")
        module, _, function = place.partition(":")
        panel[name] = getattr(importlib.import_module(module), function)
    lines = transcripts.read_lines(spark, folder)
    events = transcripts.to_events(transcripts.decode(lines)).persist()
    return comprehension.comprehension(fold(events).persist(), events, lines, panel)


BENCHES = {"detect": detect_bench, "fidelity": fidelity_bench}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="runloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("render", help="one session as a page")
    p.add_argument("session")
    p.add_argument("--out")
    p = sub.add_parser("watch", help="follow a session")
    p.add_argument("session")
    p.add_argument("--out", default="watch.html")
    p.add_argument("--poll", type=float, default=2.0)
    p.add_argument("--checkpoint", help="folder that keeps where the page stands (in spark.checkpoint.dir, else beside the page, by default)")
    p = sub.add_parser("sessions", help="the latest sessions under a folder")
    p.add_argument("folder")
    p.add_argument("-n", type=int, default=15)
    p = sub.add_parser("fleet", help="an index of many sessions")
    p.add_argument("folder")
    p.add_argument("-n", type=int, default=25)
    p.add_argument("--out", default="fleet")
    p = sub.add_parser("bench", help="scores on generated traces: of the detectors, of the fold against raw JSON, or both")
    p.add_argument("which", nargs="?", default="all", choices=[*BENCHES, "all", "comprehend"])
    p.add_argument("--folder", help="transcripts that readers are asked about (comprehend)")
    p.add_argument("--reader", action="append", default=[], help="name=module:function, a function of a prompt (comprehend)")
    p.add_argument("--more", help="transcripts of one's own for the comparison with raw JSON")
    p.add_argument("--out", help="scoreboard to keep the scores in")
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "render":
        print(render(spark, args.session, args.out))
    elif args.command == "watch":
        watch(spark, args.session, args.out, args.poll, checkpoint=args.checkpoint).awaitTermination()
    elif args.command == "sessions":
        for r in transcripts.list_sessions(spark, args.folder, args.n).collect():
            print(r["modificationTime"], r["length"], r["path"])
    elif args.command == "fleet":
        fleet(spark, args.folder, args.n, args.out)
        print(os.path.join(args.out, "index.html"))
    elif args.which == "comprehend":
        if not args.folder or not args.reader:
            parser.error("comprehend needs --folder and at least one --reader")
        scores = [r.asDict() for r in comprehend_bench(spark, args.folder, args.reader).collect()]
        if args.out:
            scoreboard(args.out, "comprehend", scores)
        print(json.dumps({"comprehend": scores}, indent=1))
    else:
        for which in BENCHES if args.which == "all" else [args.which]:
            more = {"more": args.more} if which == "fidelity" else {}
            scores = [r.asDict() for r in BENCHES[which](spark, scratch_path(spark, "bench"), **more).collect()]
            if args.out:
                scoreboard(args.out, which, scores)
            print(json.dumps({which: scores}, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
