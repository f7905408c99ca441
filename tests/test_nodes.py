"""Versions and validity against a plain store that changes one node at a time."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import nodes

VERSION = "node_id string, version int, covered_lo long, created_at_seq long, supersedes string, dependencies array<string>, note string"


def table(spark, rows):
    return spark.createDataFrame(rows, VERSION)


def first(*names):
    return [(n, 1, i, 0, None, [], "first") for i, n in enumerate(names)]


def test_updates_of_a_node_follow_each_other(spark):
    updates = spark.createDataFrame([("a", 9, "later"), ("a", 4, "sooner"), ("b", 1, "only"), ("a", 9, "last")], "node_id string, created_at_seq long, note string")
    got = {(r["node_id"], r["version"]): (r["created_at_seq"], r["supersedes"], r["note"], r["covered_lo"]) for r in nodes.evolve(table(spark, first("a", "b", "c")), updates).collect()}
    assert got == {
        ("a", 1): (0, None, "first", 0), ("a", 2): (4, "a@1", "sooner", 0), ("a", 3): (9, "a@2", "last", 0), ("a", 4): (9, "a@3", "later", 0),
        ("b", 1): (0, None, "first", 1), ("b", 2): (1, "b@1", "only", 1), ("c", 1): (0, None, "first", 2),
    }
    grown = nodes.evolve(table(spark, first("a", "b", "c")), updates)
    assert nodes.chain_errors(grown).count() == 0
    assert {r["validity"] for r in nodes.initial_validity(grown).where("ref in ('a@1', 'a@2', 'a@3')").collect()} == {"superseded"}


def test_many_updates_make_one_chain(spark):
    updates = spark.range(40).select(F.lit("a").alias("node_id"), (100 - F.col("id")).alias("created_at_seq"))
    rows = nodes.evolve(table(spark, first("a")), updates).orderBy("version").collect()
    assert [r["version"] for r in rows] == list(range(1, 42)) and [r["supersedes"] for r in rows[1:]] == [f"a@{v}" for v in range(1, 41)]
    assert [r["created_at_seq"] for r in rows] == sorted(r["created_at_seq"] for r in rows)


def test_what_does_not_follow_is_an_error(spark):
    update = spark.createDataFrame([("a", 1), ("z", 1)], "node_id string, created_at_seq long")
    with pytest.raises(KeyError, match="z"):
        nodes.evolve(table(spark, first("a")), update)
    with pytest.raises(ValueError, match="a do not follow"):
        nodes.evolve(table(spark, [*first("a"), ("a", 3, 0, 0, "a@2", [], "")]), update.where("node_id = 'a'"))
    validity = nodes.initial_validity(table(spark, first("a")))
    with pytest.raises(KeyError, match="a@7"):
        nodes.transition(validity, spark.createDataFrame([("a@7", "current")], "ref string, to string"))


def plain(validity, changes):
    state, log = dict(validity), []
    for ref, to, at in sorted(changes, key=lambda c: (c[2], list(nodes.TRANSITIONS).index(c[1]) if c[1] in nodes.TRANSITIONS else -1)):
        if to in nodes.TRANSITIONS[state[ref]] and to != state[ref]:
            state[ref] = to
            log.append((ref, to, at))
    return sorted(state.items()), sorted(log)


@pytest.mark.parametrize("seed", range(3))
def test_changes_apply_in_order_by_the_guard(spark, seed):
    rng = random.Random(seed)
    validity = [(f"n{i}@1", rng.choice(list(nodes.TRANSITIONS))) for i in range(60)]
    changes = [(rng.choice(validity)[0], rng.choice([*nodes.TRANSITIONS, "no such state"]) if rng.random() < 0.4 else rng.choice(["current", "suspected_stale"]), rng.randrange(8)) for _ in range(160)]
    before = spark.createDataFrame(validity, "ref string, validity string")
    told = spark.createDataFrame(changes, "ref string, to string, at_seq long").repartition(4)
    state, log = plain(validity, changes)
    assert sorted(map(tuple, nodes.transition(before, told).collect())) == state
    assert sorted(tuple(r) for r in nodes.audit(before, told).collect()) == log


def test_a_closure_that_is_cut_off_is_an_error(spark):
    chain = table(spark, [(f"n{i}", 1, i, 0, None, [f"n{i - 1}@1"] if i else [], "") for i in range(12)])
    roots = spark.createDataFrame([("n0@1",)], "ref string")
    assert nodes.stale_closure(chain, roots).count() == 11
    with pytest.raises(RuntimeError, match="3 rounds"):
        nodes.stale_closure(chain, roots, max_rounds=3)


@pytest.mark.parametrize("seed", range(2))
def test_a_kept_closure_is_that_computed_anew(spark, seed):
    """Waves of new versions on a random graph, with cycles, pinned and bare dependencies, and a root that comes later."""
    rng = random.Random(seed)
    last = {f"n{i}": 1 for i in range(14)}

    def row(node, version):
        deps = [f"{d}@{rng.randrange(1, last[d] + 1)}" if rng.random() < 0.4 else d for d in rng.sample(sorted(last), rng.randrange(3))]
        return (node, version, 0, 0, None, deps, "")

    versions = table(spark, [row(n, 1) for n in last])
    roots = spark.createDataFrame([("n0@1",)], "ref string")
    kept = nodes.stale_closure(versions, roots)
    for wave in range(3):
        changed = rng.sample(sorted(last), 4)
        rows = [row(n, last[n] + 1) for n in changed] + ([(f"m{wave}", 1, 0, 0, None, ["n0", "n3"], "")])
        last |= {n: last[n] + 1 for n in changed} | {f"m{wave}": 1}
        added = table(spark, rows)
        more = spark.createDataFrame([("n5@1",)], "ref string") if wave == 1 else None
        kept = nodes.advance_closure(kept, versions, added, roots, more)
        roots = roots.union(more) if more is not None else roots
        versions = table(spark, [tuple(r) for r in versions.union(added).collect()])
        want = {(r["ref"], r["depth"]) for r in nodes.stale_closure(versions, roots).collect()}
        assert {(r["ref"], r["depth"]) for r in kept.collect()} == want, wave
