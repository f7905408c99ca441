"""Versioned nodes as tables: versions(node_id, version, covered_lo, created_at_seq, supersedes, dependencies) and
validity(ref, validity). A ref is node_id@version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.session import scratch_path

#: States of a version, the graver the later; from each, those it may go to.
TRANSITIONS = {
    "current": ("current", "suspected_stale", "superseded", "invalidated"),
    "suspected_stale": ("current", "suspected_stale", "superseded", "invalidated"),
    "superseded": ("superseded", "invalidated"),
    "invalidated": ("invalidated",),
}


def ref() -> F.Column:
    return F.concat_ws("@", "node_id", "version")


def heads(versions: DataFrame) -> DataFrame:
    """The latest version of each node, in no order (by covered_lo is how they are shown)."""
    last = W.partitionBy("node_id").orderBy(F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def history(versions: DataFrame, node_id: str) -> DataFrame:
    return versions.where(F.col("node_id") == node_id).orderBy("version")


def chain_errors(versions: DataFrame) -> DataFrame:
    """Versions that do not follow: a first other than 1, a gap, or a superseded ref that does not exist."""
    order = W.partitionBy("node_id").orderBy("version")
    rows = versions.withColumn("ref", ref()).withColumn("before", F.lag("version").over(order))
    gap = F.col("version") != F.coalesce(F.col("before") + 1, F.lit(1))
    known = rows.select(F.col("ref").alias("supersedes"), F.lit(True).alias("known"))
    rows = rows.join(known, "supersedes", "left")
    return rows.where(gap | (F.col("supersedes").isNotNull() & F.col("known").isNull())).select("node_id", "version", "supersedes")


def _first(rows: DataFrame, column: str, most: int = 5) -> list[str]:
    return sorted(str(r[0]) for r in rows.select(column).distinct().limit(most).collect())


def evolve(versions: DataFrame, updates: DataFrame) -> DataFrame:
    """versions with a next version for each row of updates(node_id, created_at_seq, ...), one after another by created_at_seq.

    The other columns of an update replace the head's, and stay for later versions of its node; each version supersedes
    the one before it. Updates of one seq follow the order of their other columns; equal rows make versions of their own.
    Versions that do not follow each other, and updates of nodes that have none, are errors.
    """
    if broken := _first(chain_errors(versions), "node_id"):
        raise ValueError(f"versions of {', '.join(broken)} do not follow each other")
    head = heads(versions)
    if unknown := _first(updates.join(head, "node_id", "left_anti"), "node_id"):
        raise KeyError(f"no such node: {', '.join(unknown)}")
    others = [F.col(c) for c in updates.columns if c not in ("node_id", "created_at_seq")]
    after = W.partitionBy("node_id").orderBy("created_at_seq", *others)
    nth = updates.withColumn("_nth", F.row_number().over(after))
    new = {c: F.col(f"u.{c}") if c in updates.columns else F.col(f"h.{c}") for c in versions.columns}
    new["version"] = F.col("h.version") + F.col("u._nth")
    if "supersedes" in versions.columns:
        new["supersedes"] = F.concat_ws("@", "h.node_id", F.col("h.version") + F.col("u._nth") - 1)
    grown = head.alias("h").join(nth.alias("u"), F.col("h.node_id") == F.col("u.node_id")).select(*[v.cast(versions.schema[c].dataType).alias(c) for c, v in new.items()])
    return versions.unionByName(grown)


def initial_validity(versions: DataFrame) -> DataFrame:
    """(ref, validity): superseded if a later version exists, else current."""
    last = W.partitionBy("node_id")
    now = F.when(F.col("version") == F.max("version").over(last), "current").otherwise("superseded")
    return versions.select(ref().alias("ref"), now.alias("validity"))


def _in_order(changes: DataFrame) -> DataFrame:
    """(ref, at_seq, to) of changes(ref, to) or changes(ref, to, at_seq); without a seq all happen at once."""
    at = F.col("at_seq") if "at_seq" in changes.columns else F.lit(0)
    return changes.select("ref", at.cast("long").alias("at_seq"), "to")


def _settled(before: Column, invalid: Column, superseded: Column, last: Column) -> Column:
    """The state after changes of which some (or none) were to invalidated, to superseded, and the last to one of the open states.

    Invalidated is reached from any state and is left for none; superseded is left for that alone; the open ones give way to any.
    """
    closed = F.when(invalid | (before == "invalidated"), "invalidated").when(superseded | (before == "superseded"), "superseded")
    return closed.otherwise(F.coalesce(last, before))


def _open(to: Column) -> Column:
    return to.isin("current", "suspected_stale")


def transition(validity: DataFrame, changes: DataFrame) -> DataFrame:
    """validity after changes(ref, to, at_seq) in order; those that the states do not allow change nothing.

    Of changes at one seq the graver counts. Changes of a ref are only summed up, so a ref may have any number of them.
    A ref without a validity is an error.
    """
    if unknown := _first(changes.join(validity, "ref", "left_anti"), "ref"):
        raise KeyError(f"no such ref: {', '.join(unknown)}")
    when = lambda c: F.coalesce(c, F.lit(False))
    told = _in_order(changes).groupBy("ref").agg(
        F.bool_or(F.col("to") == "invalidated").alias("invalid"), F.bool_or(F.col("to") == "superseded").alias("replaced"),
        F.max(F.when(_open(F.col("to")), F.struct("at_seq", "to"))).alias("last"),
    )
    joined = validity.join(told, "ref", "left")
    return joined.select("ref", _settled(F.col("validity"), when(F.col("invalid")), when(F.col("replaced")), F.col("last.to")).alias("validity"))


def audit(validity: DataFrame, changes: DataFrame) -> DataFrame:
    """(ref, transition, at_seq): the changes(ref, to, at_seq) that had an effect on validity, by the rules of transition."""
    before = W.partitionBy("ref").orderBy("at_seq", "grave", "to").rowsBetween(W.unboundedPreceding, -1)
    grave = F.array_position(F.array(*[F.lit(x) for x in TRANSITIONS]), F.col("to"))
    rows = _in_order(changes).where(F.col("to").isin(*TRANSITIONS)).withColumn("grave", grave).join(validity, "ref")
    seen = lambda x: F.coalesce(F.max(F.col("to") == x).over(before), F.lit(False))
    last = F.last(F.when(_open(F.col("to")), F.col("to")), ignorenulls=True).over(before)
    rows = rows.withColumn("was", _settled(F.col("validity"), seen("invalidated"), seen("superseded"), last))
    now = _settled(F.col("was"), F.col("to") == "invalidated", F.col("to") == "superseded", F.when(_open(F.col("to")), F.col("to")))
    return rows.where(F.col("was") != now).select("ref", F.col("to").alias("transition"), "at_seq")


def dependency_edges(versions: DataFrame) -> DataFrame:
    """(on, ref): each head and each ref or bare id that it depends on."""
    return heads(versions).select(F.explode("dependencies").alias("on"), ref().alias("ref")).distinct()


def stale_closure(versions: DataFrame, roots: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(ref, depth): heads that depend on roots(ref), directly or through other heads, whatever their own state.

    Each round joins the frontier on equality (exact ref, bare id) and stops when nothing new is met. Edges and rounds
    are tables in the shared folder, so no plan grows with the rounds and a lost executor costs no round before it. A chain
    of more than max_rounds links is an error.
    """
    spark = versions.sparkSession
    folder = scratch_path(spark, "closure")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    edges = written(dependency_edges(versions), "edges")
    frontier = written(roots.select("ref").distinct().withColumn("depth", F.lit(0)), "met/round=0")
    seen = "ref string, depth int, round int"
    for depth in range(1, max_rounds + 1):
        keys = frontier.select(F.col("ref").alias("on")).union(frontier.select(F.substring_index("ref", "@", 1).alias("on"))).distinct()
        known = spark.read.schema(seen).parquet(f"{folder}/met").select("ref")
        frontier = written(keys.join(edges, "on").select("ref").distinct().join(known, "ref", "left_anti").withColumn("depth", F.lit(depth)), f"met/round={depth}")
        if not frontier.limit(1).count():
            break
    else:
        raise RuntimeError(f"the closure was not complete after {max_rounds} rounds")
    return spark.read.schema(seen).parquet(f"{folder}/met").where("depth > 0").select("ref", "depth")


def _keys(refs: DataFrame) -> DataFrame:
    """(on, depth): what a dependency on each of refs(ref, depth) may say: the ref, or its bare id."""
    bare = F.substring_index("ref", "@", 1)
    return refs.select(F.col("ref").alias("on"), "depth").union(refs.select(bare.alias("on"), "depth")).groupBy("on").agg(F.min("depth").alias("depth"))


def advance_closure(kept: DataFrame, versions: DataFrame, added: DataFrame, roots: DataFrame, new_roots: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """The stale closure (ref, depth) of versions and added together, from the one that is kept of versions and roots(ref).

    Only what the added versions, and new_roots if any, touch is followed: refs that were reached through a head that is no
    longer one are taken out (and what was reached through them), then those that are still reached, now or by new ones, are
    put in again from what was kept, and a ref that is reached sooner passes that on. Rounds are tables in the shared
    folder. An added version is the next of its node. More than max_rounds of either kind are an error.
    """
    spark, folder = versions.sparkSession, scratch_path(versions.sparkSession, "advance")

    def written(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def until_none(frontier: DataFrame, step, name: str) -> DataFrame:
        """All frontiers, each made by step(frontier, those so far)."""
        schema = frontier.schema
        for n in range(max_rounds):
            frontier = written(frontier, f"{name}/round={n}")
            so_far = spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/round={i}" for i in range(n + 1)]).select(*schema.names)
            if not frontier.limit(1).count():
                return so_far
            frontier = step(frontier, so_far)
        raise RuntimeError(f"the closure was not complete after {max_rounds} rounds")

    new_heads = written(heads(added).select("node_id", "dependencies", ref().alias("ref")), "heads")
    old_edges = written(dependency_edges(versions), "before")
    gone = heads(versions).join(new_heads.select("node_id"), "node_id", "left_semi").select(ref().alias("ref"))
    # Out: heads of before that were reached, and what was reached through them.
    first = kept.join(gone, "ref", "left_semi").select("ref")
    reached = kept.select("ref")
    out = until_none(first, lambda f, known: _keys(f.withColumn("depth", F.lit(0))).join(old_edges, "on").select("ref").distinct().join(reached, "ref", "left_semi").join(known, "ref", "left_anti"), "out").distinct()
    out = written(out, "taken")
    still = out.join(gone, "ref", "left_anti")
    edges = written(old_edges.join(gone, "ref", "left_anti").select("on", "ref").union(new_heads.select(F.explode("dependencies").alias("on"), "ref")).distinct(), "after")
    zero = roots.select("ref").union(new_roots.select("ref")) if new_roots is not None else roots.select("ref")
    zero = zero.distinct().withColumn("depth", F.lit(0))
    base = written(kept.join(out, "ref", "left_anti").select("ref", F.col("depth").cast("int").alias("depth")).union(zero).groupBy("ref").agg(F.min("depth").alias("depth")), "base")
    # In: edges to refs that were taken out or are new, and those from new roots.
    targets = still.union(new_heads.select("ref")).distinct()
    into = edges.join(targets, "ref", "left_semi").join(_keys(base), "on").select("ref", F.col("depth") + 1)
    if new_roots is not None:
        into = into.union(_keys(new_roots.select("ref", F.lit(0).alias("depth"))).join(edges, "on").select("ref", F.lit(1)))
    into = into.toDF("ref", "depth").groupBy("ref").agg(F.min("depth").alias("depth"))

    def sooner(found: DataFrame, known: DataFrame) -> DataFrame:
        best = base.union(known).groupBy("ref").agg(F.min("depth").alias("best"))
        return found.join(best, "ref", "left").where("best IS NULL OR depth < best").select("ref", "depth")

    none = spark.createDataFrame([], "ref string, depth int")
    step = lambda f, known: sooner(_keys(f).join(edges, "on").groupBy("ref").agg((F.min("depth") + 1).alias("depth")), known)
    found = until_none(sooner(into, none), step, "in")
    return base.union(found).groupBy("ref").agg(F.min("depth").alias("depth")).where("depth > 0")


def propagate(versions: DataFrame, validity: DataFrame, roots: DataFrame, root_state: str | None = None) -> DataFrame:
    """validity after roots changed to root_state (none: they keep theirs) and their current dependents became suspect."""
    if root_state:
        validity = transition(validity, roots.select("ref", F.lit(root_state).alias("to")))
    touched = stale_closure(versions, roots).select("ref", F.lit(True).alias("met"))
    joined = validity.join(touched, "ref", "left")
    return joined.select("ref", F.when(F.col("met") & (F.col("validity") == "current"), "suspected_stale").otherwise(F.col("validity")).alias("validity"))
