"""Following transcripts: every micro-batch of appended lines changes the keyed state of its sessions.

A session's state is kept by Spark's state store: one typed value of what has a
bound (counters, open anomalies, the open episode), one of the live facts, and a
map for each table of the fold (ids of messages and calls, tools, files, ...), whose
keys lie in buckets; tables of one bucket lie in the first value. A batch reads and
writes the buckets that its rows touch, so it costs what it changes and not what the
session holds, and a restart goes on from the checkpoint.

What comes out is a log of changes, rows of CHANGES: the newest row of a (path,
part, key) holds, and rows that come twice after a failure say the same. `current`
puts the log together to rows of STATE. Rows of a batch are put in order of their
place and block first. No watermark: nothing is dropped as late. State lives as
long as its session unless idle_ms is given, which a timer sees to.
"""

from __future__ import annotations

import itertools
import json
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import ArrayType

from runloom.operators.fold import MAX_EPISODES, ROW, STATE, VERSION, Limits, SessionFold, Table, prepare
from runloom.schema import schema_of
from runloom.sources.transcripts import decode, stream_lines, to_events

#: Bytes of a task's range: a batch's lines are decoded in Python, which takes longer than reading them.
SPLIT = 4 << 20
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSION_FIELDS = schema_of(f"x {VERSION}")["x"].dataType.names
#: The tables of the fold that are kept by key, and the keys of a bucket on average.
TABLES = ("used", "models", "tools", "files", "in_flight", "calls", "folded", "folded_keys", "heads", "open", "hung")
FULL = 64
ANOMALY = "struct<kind:string,severity:string,message:string,detected_at_seq:long,cleared_at_seq:long,evidence:array<long>,place:long>"
COUNTS = ("n_events", "sidechain_events", "n_turns", "n_tool_calls", "n_tool_errors")
PLACES = ("goal_text", "latest_user_directive", "last_agent_text", "frontier", "started_us", "last_us")
HEAD = (
    ", ".join(f"{c} long" for c in COUNTS) + ", goal_text string, latest_user_directive string, last_agent_text string, frontier string, started_us long, last_us long, "
    f"session_id string, seq long, tokens array<long>, paid string, failures array<string>, alarms array<{ANOMALY}>, n_fired long, "
    "window array<struct<tool:string,sha256:string,seq:long>>, looping array<string>, diverged long, streak array<long>, streak_n long, clock_us long, flying long, called long, placed long, "
    "n_episodes long, n_open long, n_written long, now struct<node:string,lo:long,hi:long,ask:string,tools:array<struct<name:string,n:long>>,calls:long,errors:long,pins:array<long>,said:string,t0:long,t1:long,fed:long>, "
    "tables string"
)
FACTS = "facts array<struct<key:string,value:string,place:long>>"
#: What a session's newest row of part head says of it.
TOLD = (
    "struct<session_id:string,n_events:long,sidechain_events:long,n_turns:long,n_tool_calls:long,n_tool_errors:long,goal_text:string,latest_user_directive:string,"
    "last_agent_text:string,frontier:string,started_us:long,last_us:long,tokens:array<long>,cost_usd:double,recent_failures:array<string>>"
)
#: part: head, model, tool, file, call, fact, aggregate, folded, anomaly or version; gone: the key is no longer there.
CHANGES = f"path string, observed_seq long, part string, key string, place long, gone boolean, n long, text string, head {TOLD}, anomaly {ANOMALY}, version {VERSION}"


def bucket_of(key: str, n: int) -> int:
    """The bucket of n that a key lies in, by linear hashing: one bucket more takes keys of one other only."""
    code, low = zlib.crc32(key.encode("utf-8", "surrogatepass")), 1 << (n.bit_length() - 1)
    at = code & (2 * low - 1)
    return at if at < n else code & (low - 1)


class Stored(Table):
    """A table of the fold over a map of the state store, whose keys lie in buckets: one is read when a key of it is asked for
    and written when a batch ends that changed it, so a message to the store is for some FULL keys.

    The number of buckets follows that of keys, one at a time. A table of one bucket lies in the session's HEAD (held: its
    keys, or the number of its buckets and of its keys), so a short session reads and writes nothing else.
    """

    def __init__(self, name: str, state, held: dict | list | None = None):
        super().__init__(name)
        self.state = state
        self.n, self.count = held if isinstance(held, list) else (1, len(held or ()))
        self.stored = self.n > 1
        self.buckets: dict[int, dict] = {} if self.stored else {0: held or {}}
        self.written: set[int] = set()
        self.changed: set[str] = set()
        self.cleared = False

    def _bucket(self, at: int) -> dict:
        if at not in self.buckets:
            found = self.state.getValue((at,)) if self.stored and not self.cleared else None
            self.buckets[at] = json.loads(found[0]) if found is not None else {}
        return self.buckets[at]

    def get(self, key: str, default=None):
        return self._bucket(bucket_of(key, self.n)).get(key, default) if key else default

    def __setitem__(self, key: str, value) -> None:
        at = bucket_of(key, self.n)
        bucket = self._bucket(at)
        self.count += key not in bucket
        bucket[key] = value
        self.written.add(at)
        self.changed.add(key)
        while self.count > FULL * self.n:
            self._grow()

    def _grow(self) -> None:
        """One bucket more, with keys of the one that it is split from."""
        at, new = self.n - (1 << (self.n.bit_length() - 1)), self.n
        bucket, self.n = self._bucket(at), new + 1
        self.buckets[new] = {k: bucket.pop(k) for k in [k for k in bucket if bucket_of(k, self.n) == new]}
        self.written |= {at, new}

    def __getitem__(self, key: str):
        return self.get(key)

    def remove(self, key: str):
        found = self.get(key)
        if found is not None:
            at = bucket_of(key, self.n)
            del self.buckets[at][key]
            self.count -= 1
            self.written.add(at)
            self.changed.add(key)
        return found

    def items(self):
        if self.stored and not self.cleared:
            for (at,), found in self.state.iterator():
                self.buckets.setdefault(at, json.loads(found[0]))
        return [x for bucket in self.buckets.values() for x in bucket.items()]

    def clear(self) -> None:
        self.buckets, self.n, self.count = {0: {}}, 1, 0
        self.written, self.changed, self.cleared = {0}, set(), True

    def save(self) -> dict:
        """Write what changed; the new values by key, None for those that are gone."""
        if self.stored and self.cleared:
            self.state.clear()
        if self.n > 1:
            for at in self.written:
                self.state.updateValue((at,), (json.dumps(self.buckets[at]),))
        return {k: self.get(k) for k in self.changed}

    def held(self) -> dict | list:
        return [self.n, self.count] if self.n > 1 else self.buckets[0]


def restore(fold: SessionFold, head: tuple | None, facts: tuple | None) -> None:
    """Put the values of HEAD and FACTS back into a new fold."""
    if head is None:
        return
    h = dict(zip(schema_of(HEAD).names, head))
    for name in COUNTS:
        fold.n[name] = h[name]
    for name in PLACES:
        fold.at[name] = h[name]
    fold.session_id, fold.seq, fold.tokens, fold.ten_thousandths = h["session_id"], h["seq"], list(h["tokens"]), int(h["paid"])
    fold.failures.extend(h["failures"])
    for x in h["alarms"]:
        fold.alarms[x[0]].open = {"kind": x[0], "severity": x[1], "message": x[2], "detected_at_seq": x[3], "cleared_at_seq": x[4], "evidence": list(x[5]), "place": x[6]}
    for tool, sha256, seq in h["window"]:
        fold.window.push((tool, sha256), seq)
    fold.looping, fold.diverged = tuple(h["looping"]) or None, h["diverged"]
    fold.streak.extend(h["streak"])
    fold.streak_n, fold.last_us, fold.flying, fold.called, fold.n_fired = h["streak_n"], h["clock_us"], h["flying"], h["called"], h["n_fired"]
    for key, value, place in facts[0] if facts else ():
        fold.facts.live[key] = (value, place)
    fold.facts.placed = h["placed"]
    e = fold.episodes
    e.n, e.n_open, e.n_written = h["n_episodes"], h["n_open"], h["n_written"]
    if h["now"] is not None:
        now = dict(zip(("node", "lo", "hi", "ask", "tools", "calls", "errors", "pins", "said", "t0", "t1", "fed"), h["now"]))
        e.now = now | {"tools": {name: n for name, n in now["tools"]}, "pins": list(now["pins"])}


def kept(fold: SessionFold, tables: dict[str, Stored]) -> tuple:
    """The value of HEAD of a fold and its tables."""
    e, now, alarm = fold.episodes, None, schema_of(f"x {ANOMALY}")["x"].dataType.names
    if e.now is not None:
        d = e.now
        now = (d["node"], d["lo"], d["hi"], d["ask"], list(d["tools"].items()), d["calls"], d["errors"], d["pins"], d["said"], d["t0"], d["t1"], d["fed"])
    return (
        *(fold.n[c] for c in COUNTS), *(fold.at[c] for c in PLACES), fold.session_id, fold.seq, list(fold.tokens), str(fold.ten_thousandths), list(fold.failures),
        [tuple(a.open[f] for f in alarm) for a in fold.alarms.values() if a.open is not None], fold.n_fired, fold.window.rows(), list(fold.looping or ()), fold.diverged,
        list(fold.streak), fold.streak_n, fold.last_us, fold.flying, fold.called, fold.facts.placed, e.n, e.n_open, e.n_written, now,
        json.dumps({name: t.held() for name, t in tables.items() if t.count or t.n > 1}),
    )


#: Columns of prepared rows that go to Python as one text, which takes far less time there than as many columns.
PACKED = [c for c in schema_of(ROW).names if c not in ("path", "seq")] + ["byte_offset", "block_index"]
_NONE = dict.fromkeys(PACKED)
#: Changes that come from Python as one text.
TOGETHER = 64
_UNCHANGED = dict.fromkeys(("part", "key", "place", "gone", "n", "text", "head", "anomaly", "version")) | {"gone": False}


def opened(row: Row) -> dict:
    """A row by name, unpacked where its columns are packed."""
    return _NONE | json.loads(row[-1]) if row.__fields__[-1] == "packed" else row.asDict(recursive=True)


class Sessions(StatefulProcessor):
    """Folds the rows of a batch into the state of their session and gives out what changed."""

    def __init__(self, limits: Limits, idle_ms: int | None = None):
        self.limits, self.idle_ms = limits, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head, self.facts = handle.getValueState("head", schema_of(HEAD)), handle.getValueState("facts", schema_of(FACTS))
        self.maps = {name: handle.getMapState(name, schema_of("bucket long"), schema_of("entries string")) for name in TABLES}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        changes = self.folded(key[0], [opened(r) for r in rows])
        while some := list(itertools.islice(changes, TOGETHER)):
            yield Row(changes=json.dumps(some))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.head, self.facts, *self.maps.values()):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass

    def folded(self, path: str, rows: list[dict]) -> Iterator[dict]:
        tables: dict[str, Stored] = {}
        head = self.head.get()
        held = json.loads(head[-1]) if head is not None else {}

        def table(name: str) -> Stored:
            tables[name] = Stored(name, self.maps[name], held.get(name))
            return tables[name]

        fold = SessionFold(self.limits, table=table)
        restore(fold, head, self.facts.get() if head is not None else None)
        before = {k: dict(a.open) for k, a in fold.alarms.items() if a.open is not None}
        known = [a.open for a in fold.alarms.values() if a.open is not None]
        for row in sorted(rows, key=lambda r: (r["byte_offset"], r["block_index"])):
            fold.step(row | {"seq": fold.seq + 1})
        out = list(self._changes(fold, tables, [a for a in known if a != before[a["kind"]]] + fold.fired))
        self.head.update(kept(fold, tables))
        if fold.facts.changed:
            self.facts.update(([(k, v, place) for k, (v, place) in fold.facts.live.items()],))
        for change in out:
            yield {"path": path, "observed_seq": fold.seq} | _UNCHANGED | change

    @staticmethod
    def _changes(fold: SessionFold, tables: dict[str, Stored], anomalies: list[dict]) -> Iterator[dict]:
        told = {"session_id": fold.session_id} | fold.n | fold.at | {"tokens": list(fold.tokens), "cost_usd": fold.cost_usd, "recent_failures": list(fold.failures)}
        yield {"part": "head", "key": "", "head": told}
        saved = {name: t.save() for name, t in tables.items()}
        for name, part in (("models", "model"), ("tools", "tool"), ("files", "file")):
            for key, (n, first) in saved[name].items():
                yield {"part": part, "key": key, "place": first, "n": n}
        for key, c in saved["calls"].items():
            yield {"part": "call", "key": key, "place": c["first_seq"], "gone": not c["open"], "n": c["call_seq"], "text": c["tool_name"]}
        for key in sorted(fold.facts.changed):
            value, place = fold.facts.live.get(key, (None, None))
            yield {"part": "fact", "key": key, "place": place, "gone": place is None, "text": value}
        for base, (n, total, place) in saved["folded"].items():
            yield {"part": "aggregate", "key": base, "place": place, "n": n, "text": str(total)}
        for key, (base, place) in saved["folded_keys"].items():
            yield {"part": "folded", "key": key, "place": place, "text": base}
        for a in anomalies:
            yield {"part": "anomaly", "key": f"{a['kind']}@{a['place']}", "place": a["place"], "anomaly": a}
        for v in fold.episodes.versions:
            yield {"part": "version", "key": f"{v['node_id']}@{v['version']}", "place": v["place"], "version": {n: v[n] for n in VERSION_FIELDS}}


def live_changes(events: DataFrame, limits: Limits | None = None, idle_ms: int | None = None) -> DataFrame:
    """Rows of CHANGES for each session that a micro-batch of events touches; its open episode stays open."""
    rows = prepare(events.withColumn("seq", F.struct(F.col("raw.byte_offset"), F.col("raw.block_index")))).select("*", "seq.byte_offset", "seq.block_index").select("path", F.to_json(F.struct(*PACKED)).alias("packed"))
    told = rows.groupBy("path").transformWithState(Sessions(limits or Limits(), idle_ms), schema_of("changes string"), "Update", "ProcessingTime" if idle_ms else "None")
    return told.select(F.explode(F.from_json("changes", ArrayType(schema_of(CHANGES)), {"mode": "FAILFAST"})).alias("c")).select("c.*")


def newest(changes: DataFrame) -> DataFrame:
    """The rows of changes that hold."""
    rest = [c for c in changes.columns if c not in ("path", "part", "key")]
    last = changes.groupBy("path", "part", "key").agg(F.max_by(F.struct(*rest), "observed_seq").alias("c"))
    return last.select("path", "part", "key", "c.*").where("NOT gone")


def current(changes: DataFrame) -> DataFrame:
    """Rows of STATE as of the newest changes: every field is that of the fold of the events so far, but for open episodes, which are not ended."""
    rows = newest(changes)

    def listed(part: str, *fields):
        one = F.when(F.col("part") == part, F.struct(F.col("place"), F.col("key"), F.struct(*fields).alias("x")))
        return F.transform(F.sort_array(F.collect_list(one)), lambda r: r["x"])

    name_n, at = (F.col("key").alias("name"), F.col("n")), lambda c: F.max(F.when(F.col("part") == "head", F.col(c)))
    found = rows.groupBy("path").agg(
        at("observed_seq").alias("observed_seq"), at("head").alias("h"),
        *[listed(part, *name_n).alias(f"{part}s") for part in ("model", "tool", "file")],
        listed("call", F.col("key").alias("correlation_id"), F.col("text").alias("tool_name"), F.col("n").alias("call_seq")).alias("pending"),
        listed("fact", "key", F.col("text").alias("value")).alias("facts"),
        listed("aggregate", F.col("key").alias("base"), "n", F.col("text").alias("total")).alias("sums"),
        listed("folded", F.col("text").alias("base"), "key").alias("folded"),
        listed("anomaly", "anomaly").alias("fired"), listed("version", "version").alias("written"),
    )
    gone = F.transform("sums", lambda s: F.struct(s["base"].alias("base"), s["n"].alias("n"), s["total"].alias("total"), F.transform(F.filter("folded", lambda f: f["base"] == s["base"]), lambda f: f["key"]).alias("keys")))
    versions = F.transform("written", lambda v: v["version"])
    last = F.filter(versions, lambda v: ~F.exists(versions, lambda w: (w["node_id"] == v["node_id"]) & (w["version"] > v["version"])))
    episodes = F.sort_array(F.transform(last, lambda v: F.struct(v["covered_lo"].alias("lo"), v.alias("v"))))
    shown = F.slice(F.transform(episodes, lambda e: e["v"]), F.greatest(F.size(episodes) - MAX_EPISODES + 1, F.lit(1)), MAX_EPISODES)
    anomaly = [f for f in schema_of(f"x {ANOMALY}")["x"].dataType.names if f != "place"]
    out = {
        "path": F.col("path"), "observed_seq": F.col("observed_seq"), "pending": F.col("pending"), "facts": F.col("facts"), "aggregates": gone, "models": F.col("models"), "tools": F.col("tools"), "files": F.col("files"),
        "anomalies": F.transform("fired", lambda a: F.struct(*[a["anomaly"][f].alias(f) for f in anomaly])), "versions": versions, "episodes": shown,
    }
    return found.select(*[out.get(f.name, F.col(f"h.{f.name}")).cast(f.dataType).alias(f.name) for f in STATE.fields])


def keep(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for `follow` that keeps the log of changes as a table; a batch that is tried again replaces its own part."""

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return write


def kept_changes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(schema_of(CHANGES)).parquet(folder)


@dataclass
class Parsed(StreamingQueryListener):
    """Parse statistics of a followed stream: one dict a batch in `batches`, which on_batch also gets."""

    name: str
    on_batch: Callable[[dict], None] | None = None
    batches: list[dict] = field(default_factory=list)
    listening: bool = False

    def listen(self, spark: SparkSession) -> None:
        """Begin to hear of the session's streams, once however often it is called."""
        if not self.listening:
            spark.streams.addListener(self)
            self.listening = True

    def stop(self, spark: SparkSession) -> None:
        if self.listening:
            spark.streams.removeListener(self)
            self.listening = False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = (event.progress.observedMetrics or {}).get(self.name)
        if seen is not None and any(seen.asDict().values()):
            row = {"batch": event.progress.batchId} | seen.asDict()
            self.batches.append(row)
            if self.on_batch:
                self.on_batch(row)

    def onQueryIdle(self, event) -> None:
        pass

    def total(self) -> dict:
        """Sums over the batches; one that was tried again counts once."""
        last = {b["batch"]: b for b in self.batches}
        return {k: sum(b[k] for b in last.values()) for k in STATISTICS}

    def onQueryTerminated(self, event) -> None:
        pass


def told(spark: SparkSession, parsed: Parsed, events: int, timeout_s: float = 30.0) -> dict:
    """The total of parsed once it has so many events: listeners hear of a batch some time after it is done."""
    end = time.monotonic() + timeout_s
    while parsed.total()["events"] < events and time.monotonic() < end:
        time.sleep(0.05)
    return parsed.total()


#: Statistics that `observed` gives a stream of decoded lines; a line is counted by the first of its rows.
STATISTICS = {
    "lines": "count_if(block_index = 0)", "events": "count_if(outcome = 'event')", "malformed": "count_if(outcome = 'malformed')", "rejected": "count_if(outcome = 'rejected')",
    "blank": "count_if(outcome = 'blank')", "unknown": "count_if(kind = 'unknown')",
}


def observed(decoded: DataFrame, name: str) -> DataFrame:
    """decoded, with the statistics of each batch as metrics of the name."""
    return decoded.observe(name, *[F.expr(e).alias(n) for n, e in STATISTICS.items()])


def follow(spark: SparkSession, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], limits: Limits | None = None, every: str | None = None, max_bytes: int = 1 << 30, idle_ms: int | None = None, parsed: Parsed | None = None) -> StreamingQuery:
    """Tail the transcripts under path; on_batch gets the changes of each batch. Without `every`, it stops when all that is there is
    read, in one batch over as many tasks as it needs; with it, a batch has max_bytes at most beyond the one before.

    What is read of each file is kept in a manifest beside the checkpoint, so offsets stay small and a restart keeps to
    max_bytes too. Keyed state needs the RocksDB state store, which is set in the session. parsed gets the parse statistics of each batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    decoded = decode(stream_lines(spark, path, manifest=f"{checkpoint}-files", split=SPLIT, **({"maxBytes": max_bytes} if every else {})))
    if parsed is not None:
        decoded = observed(decoded, parsed.name)
        parsed.listen(spark)
    writer = live_changes(to_events(decoded, with_seq=False), limits, idle_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
