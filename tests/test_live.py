"""The keyed state of a stream against the fold of the same events, and what a batch reads and writes of it."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from runloom.operators.fold import STATE, Limits, SessionFold, fold
from runloom.sources import fixtures, transcripts
from runloom.streaming import live
from tests.test_fold import BASE, call, result, turn

#: Fields that the end of a session changes, as it ends the open episode.
ENDED = {"versions", "episodes"}


class Value:
    def __init__(self):
        self.held, self.uses = None, 0

    def exists(self):
        return self.held is not None

    def get(self):
        self.uses += 1
        return self.held

    def update(self, value):
        self.uses += 1
        self.held = value

    def clear(self):
        self.held = None


class Map:
    def __init__(self):
        self.held, self.uses = {}, 0

    def getValue(self, key):
        self.uses += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.uses += 1
        self.held[key] = value

    def removeKey(self, key):
        self.uses += 1
        self.held.pop(key, None)

    def iterator(self):
        self.uses += len(self.held)
        return iter(list(self.held.items()))

    def clear(self):
        self.uses += 1
        self.held.clear()


class Handle:
    """The state of one session, in memory; counts what is read and written."""

    def __init__(self):
        self.all = []
        self.timers = []

    def _new(self, kind):
        self.all.append(kind())
        return self.all[-1]

    def getValueState(self, name, schema, ttl=None):
        return self._new(Value)

    def getMapState(self, name, key, value, ttl=None):
        return self._new(Map)

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    @property
    def uses(self):
        return sum(x.uses for x in self.all)


def processor(**limits):
    p = live.Sessions(Limits(**limits))
    p.init(Handle())
    return p


def placed(rows, start=0):
    return [BASE | r | {"byte_offset": start + i, "block_index": 0} for i, r in enumerate(rows)]


def session(rng, n, many=True):
    """Random steps of a session; ids are used again, results are late, facts are evicted."""
    rows = []
    for i in range(n):
        ident = f"c{rng.randrange(max(2, i // 2) if many else 6)}"
        paid = {"usage_key": f"u{rng.randrange(i + 1)}", "micros": f"{rng.randrange(9)}.5000", "tokens": [1, 2, 0, 1], "model": rng.choice(["a", "b", None])} if rng.random() < 0.5 else {}
        rows.append(rng.choice([
            call(ident, tool=rng.choice(["T", "U", ""]), sha=rng.choice("xy"), file=rng.choice([None, "/f", "/g"]), us=i * 10**8, input_source=rng.choice([None, "s"]), **paid), call("", **paid),
            result(ident, bad=rng.random() < 0.6, head="bad", us=i * 10**8, facts=[{"key": rng.choice(["k", "retries", "t"]), "value": str(rng.randrange(30))}]), result(ident, bad=True),
            turn(f"ask {i}", us=i * 10**9), {"kind": "message", "source": "user", "said": ""}, {"kind": "message", "said": f"hm {i}"}, {"kind": "error", "head": "api"}, call(ident, main=False, **paid),
        ]))
    return rows


LIMITS = {"max_facts": 5, "stall_s": 50, "flood_cap": 7, "warn_usd": 1e-5, "critical_usd": 3e-5}


@pytest.mark.parametrize("seed", range(4))
def test_any_batches_give_the_state_of_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = session(rng, 240, many=seed % 2 == 0)
    p, out, at = processor(**LIMITS), [], 0
    while at < len(rows):
        end = at + rng.choice([1, 2, 7, 30])
        batch = placed(rows[at:end], at)
        rng.shuffle(batch)
        out += p.folded("p", batch)
        at = end
    held = SessionFold(Limits(**LIMITS))
    for i, r in enumerate(rows):
        held.step(BASE | {"seq": i} | r)
    want = held.state("p")
    got = live.current(spark.createDataFrame(out + out[-9:], live.schema_of(live.CHANGES))).first().asDict(recursive=True)
    for name in set(STATE.names) - ENDED:
        assert got[name] == want[name], name
    assert got["versions"] == want["versions"][: len(got["versions"])] and len(want["versions"]) - len(got["versions"]) <= 2
    assert {e["node_id"]: e for e in got["episodes"]}.keys() == {e["node_id"] for e in want["episodes"]}


def test_a_batch_costs_what_it_changes_and_not_what_the_session_holds():
    p = processor(loop_repeats=10**9, flood_cap=10**9)
    rows = [turn()]
    for i in range(100_000):
        rows += [call(f"c{i}", sha=str(i), usage_key=f"u{i}", micros="1.0000", tokens=[1, 1, 1, 1], model="m")] + [result(f"c{i}")] * (i % 2)
    list(p.folded("p", placed(rows)))
    before = p.handle.uses
    out = list(p.folded("p", placed([call("new", usage_key="u-new", micros="1.0000", tokens=[1, 1, 1, 1], model="m")], len(rows))))
    assert p.handle.uses - before < 40 and len(out) < 8
    before = p.handle.uses
    out = list(p.folded("p", placed([result("c0", facts=[{"key": "k", "value": "1"}])], len(rows) + 1)))
    assert p.handle.uses - before < 40 and len(out) < 8
    assert [r["n"] for r in out if r["part"] == "call"] == [1] and [r["gone"] for r in out if r["part"] == "call"] == [True]


def test_an_idle_session_is_forgotten():
    class Time:
        def getCurrentProcessingTimeInMs(self):
            return self.now

    p, clock = processor(), Time()
    p.idle_ms, clock.now = 100, 1000
    row = Row(**placed([call("a")])[0])
    list(p.handleInputRows(("p",), iter([row]), clock))
    clock.now = 1050
    list(p.handleInputRows(("p",), iter([row]), clock))
    assert p.handle.timers == [1150]
    assert list(p.handleExpiredTimer(("p",), clock, None)) == []
    assert [r["head"]["n_events"] for r in p.folded("p", placed([call("a")])) if r["part"] == "head"] == [1]


def test_following_a_file_gives_the_state_of_the_whole(spark, tmp_path):
    """Appended in parts, over restarts of the query: the log gives every field of the fold, and its versions."""
    lines = fixtures.session_trace(5, 6).lines().encode()
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for n, cut in enumerate((len(lines) // 3, len(lines) // 3 + 40, len(lines))):
        (src / "s.jsonl").write_bytes(lines[:cut])
        live.follow(spark, str(src), str(tmp_path / "ck"), live.keep(out)).awaitTermination()
    changes = live.kept_changes(spark, out)
    got, want = live.current(changes).first().asDict(recursive=True), fold(transcripts.read_events(spark, str(src))).first().asDict(recursive=True)
    for name in set(STATE.names) - ENDED:
        assert got[name] == want[name], name
    assert got["versions"] and want["versions"][: len(got["versions"])] == got["versions"]
    assert changes.select("observed_seq").distinct().count() > 1


def test_statistics_of_batches_add_up(spark, tmp_path):
    good = fixtures.session_trace(2, 3).lines().encode()
    odd = b'not json\n[1]\n\n{"type": "assistant", "message": 5}\n{"type": "x-new"}\n{"type": "summary", "summary": "s"}\n'
    src, seen = tmp_path / "in", live.Parsed("parsed")
    src.mkdir()
    try:
        for cut in (good[:300], good + odd, good + odd + odd + b"unfinished"):
            (src / "s.jsonl").write_bytes(cut)
            live.follow(spark, str(src), str(tmp_path / "ck"), lambda df, _: df.write.format("noop").mode("overwrite").save(), parsed=seen).awaitTermination()
        lines = transcripts.read_lines(spark, str(src))
        decoded = transcripts.decode(lines)
        want = transcripts.parse_stats(lines, decoded).first()
        total = live.told(spark, seen, want["events"])
    finally:
        seen.stop(spark)
    assert len({b["batch"] for b in seen.batches}) >= 2
    assert (total["lines"], total["events"], total["malformed"], total["rejected"]) == (want["lines"], want["events"], want["malformed"], want["rejected"])
    assert total["blank"] == 2 and total["unknown"] == decoded.where(F.col("kind") == "unknown").count() == 2


def test_a_session_of_many_keys_sends_few_messages_to_the_store():
    """A short session is one value of the store beside its facts; a long one sends a message for some FULL keys, and any key is found again."""
    rows = [turn()] + [call(f"c{i}", sha=str(i), usage_key=f"u{i}", micros="1.0000", tokens=[1, 1, 1, 1], model="m") for i in range(20_000)]
    short, long = processor(), processor()
    list(short.folded("p", placed(rows[:60])))
    list(long.folded("p", placed(rows)))
    assert short.handle.uses <= 3 and long.handle.uses < 4 * len(rows) / live.FULL * 2 + 50
    again = [call(f"c{i}", usage_key=f"u{i}", micros="1.0000", tokens=[1, 1, 1, 1], model="m") for i in range(0, 20_000, 997)]
    out = list(long.folded("p", placed(again, len(rows))))
    assert [r["head"]["tokens"] for r in out if r["part"] == "head"] == [[20_000] * 4]
    assert sorted(r["place"] for r in out if r["part"] == "call") == [i + 1 for i in range(0, 20_000, 997)]


def test_tables_in_buckets_are_those_of_a_dict():
    rng, held, want = random.Random(3), None, {}
    store = Map()
    for _ in range(60):
        t = live.Stored("files", store, held)
        if rng.random() < 0.05:
            t.clear()
            want = {}
        for _ in range(rng.choice([1, 5, 200])):
            key = f"k{rng.randrange(900)}"
            if rng.random() < 0.3:
                assert t.remove(key) == want.pop(key, None)
            else:
                t[key] = want[key] = [rng.randrange(9), 1]
        probe = f"k{rng.randrange(900)}"
        assert t.get(probe) == want.get(probe)
        if rng.random() < 0.3:
            assert dict(t.items()) == want
        t.save()
        held = t.held()
        assert t.count == len(want)
    assert dict(live.Stored("files", store, held).items()) == want
