"""Approximate nearest neighbours by largest inner product: adaptive dimension scan over inverted lists.

Vectors are cut into bands of norm (a band's norms differ by less than a factor of
two). Within a band, inner products become distances: vectors are divided by the
band's largest norm and lifted by one more component to length one, queries are
divided by their own norm. So a few very long vectors change nothing for the
others, and what is compared in single precision lies between zero and four
whatever the norms. Lifted vectors are turned by a random orthogonal matrix, so any
leading part of them is a random sample of their dimensions, and dealt into lists
around centroids of their band, fitted on a bounded sample. A block holds up to
BLOCK vectors of a group of lists in column blocks of dimensions.

A query probes, in each band, the lists nearest to it. Within each, partial
distances grow by one column block at a time; after each, a candidate is abandoned
if its partial distance, scaled to all dimensions, exceeds what the query's bound
allows by more than EPSILON standard errors (of a sample of so many of the
dimensions without replacement). The bound is a score, in double precision, that
the k-th best reaches at least: first that of the sample. In a band it allows a
distance of 2 - 2 bound / (norm of the query * largest norm of the band), so by
Cauchy and Schwarz a band whose vectors are too short is left out whole. What
survives all blocks is scored in double precision on the original vectors.

Blocks are stored once, their vectors turned and cut into column blocks beside
the original ones. They are dealt by group and salt, so that a key holds SALTED
vectors or so however many one list has; query batches are copied for the salts.
Queries meet the blocks of their nearest lists first; the k-th best of what that
finds bounds the search of the others, in which a list is left out for a query
if no vector so near can lie in it (by the triangle inequality on its radius).
Within a meeting, what is found bounds the lists after it. Each meeting gives at
most k rows a query, and no task holds a whole list. At least ``least_probes``
lists and ``probe_share`` of all of a band are probed (README has the recall); a
band that the sample hardly has is one list, and so searched whole.

Defined cases: vectors that are null, zero, of another length than the sample's
most common one, or hold null or non-finite components, and rows without an id,
take no part; norms may be of any size (a score beyond the range of doubles is
infinite, and such scores tie); rows with the query's own id are no candidates; of
rows with one id, the best counts; with fewer than k candidates all are returned;
vectors of any length are one value each and go to Python in bounded batches; an
empty table gives an empty result. Only the id and the vector are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.common import bounded_batches, table, written

SAMPLE = 16_384
COLUMNS = 16
EPSILON = 2.1
BLOCK = 2_048
QUERIES = 512
#: Vectors that are dealt into groups at once.
HELD = 8_192
GROUPS = 64
#: Vectors of a group that share a salt.
SALTED = 1 << 16
#: Share of the probed lists that are searched first.
FIRST = 0.1
DENSE = 0.2
#: Relative slack for single-precision partial distances.
SLACK = 1e-4


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms of the rows, none of whose squares leaves the range of doubles."""
    most = np.abs(x).max(axis=1, initial=0.0)
    scaled = x / np.where(most > 0, most, 1.0)[:, None]
    return most * np.sqrt(np.einsum("ij,ij->i", scaled, scaled))


class Index:
    """Rotation, bands, centroids and the sample's vectors; everything here has a fixed bound.

    bands has, in order, the largest norm and the number of vectors of each (some two thousand at most, as doubles have so
    many powers of two).
    """

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, bands: list[tuple[float, int]], distinct: bool, probe_share: float, least_probes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.width, self.distinct = sample.shape[1], distinct
        self.tops = np.array([top for top, _ in bands])
        full = self.width + 1
        self.rotation = np.linalg.qr(rng.normal(size=(full, full)))[0]
        self.sample_ids, self.sample = sample_ids, sample
        turned, of = self.turned(sample)
        centroids, self.of_band, self.probes = [], [], []
        for b, (_, rows) in enumerate(bands):
            mine = turned[of == b]
            lists = max(1, min(int(np.ceil(np.sqrt(rows))), len(mine) // 8))
            centroids.append(self._fit(mine, lists, rng) if len(mine) else self.rotation[-1:].astype(np.float32))
            self.of_band += [b] * lists
            self.probes.append(min(lists, max(least_probes, int(np.ceil(probe_share * lists)))))
        self.centroids, self.of_band = np.concatenate(centroids), np.array(self.of_band)
        self.starts = np.searchsorted(self.of_band, np.arange(len(bands) + 1))
        self.sample_lists = self.lists_of(turned, of)
        lists = len(self.of_band)
        self.groups = min(GROUPS, lists)
        self.salts = max(1, sum(rows for _, rows in bands) // (self.groups * SALTED))

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors in the scale of their band, lifted and turned; and their bands."""
        band = np.minimum(np.searchsorted(self.tops, norms(x)), len(self.tops) - 1)
        unit = x / self.tops[band][:, None]
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
        return (np.concatenate([unit, rest[:, None]], axis=1) @ self.rotation).astype(np.float32), band

    def queries(self, x: np.ndarray) -> np.ndarray:
        unit = x / norms(x)[:, None]
        return (np.concatenate([unit, np.zeros((len(x), 1))], axis=1) @ self.rotation).astype(np.float32)

    def _fit(self, sample: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
        for _ in range(rounds):
            of = self.nearest(sample, centroids)
            order = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(of[order]) > 0]))
            sums = np.add.reduceat(sample[order].astype(np.float64), starts, axis=0)
            sizes = np.diff(np.append(starts, len(order)))
            centroids[of[order][starts]] = sums / sizes[:, None]
        return centroids

    @staticmethod
    def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        half = 0.5 * np.einsum("ij,ij->i", centroids, centroids)
        return np.concatenate([np.argmin(half - x[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def lists_of(self, turned: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The list of each vector, of those of its band."""
        out = np.zeros(len(turned), np.int64)
        for b in np.unique(band):
            own = band == b
            out[own] = self.starts[b] + self.nearest(turned[own], self.centroids[self.starts[b] : self.starts[b + 1]])
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """[queries, lists]: distance of each turned query from each centroid."""
        c = self.centroids.astype(np.float64)
        square = np.einsum("ij,ij->i", q, q, dtype=np.float64)[:, None] + np.einsum("ij,ij->i", c, c) - 2 * (q.astype(np.float64) @ c.T)
        return np.sqrt(np.maximum(square, 0))

    def probed(self, q: np.ndarray, first: bool) -> np.ndarray:
        """[queries, lists]: whether a query probes a list, first or afterwards."""
        far = self.distances(q)
        out = np.zeros(far.shape, bool)
        for a, b, probes in zip(self.starts, self.starts[1:], self.probes):
            early = min(probes, max(1, int(np.ceil(FIRST * probes))))
            order = a + np.argsort(far[:, a:b], axis=1, kind="stable")
            np.put_along_axis(out, order[:, :early] if first else order[:, early:probes], True, axis=1)
        return out

    def bounds(self, ids: np.ndarray, x: np.ndarray, probed: np.ndarray, k: int) -> np.ndarray:
        """Score of each query's k-th best vector of the sample in the given lists, itself left out; without so many, none."""
        if len(self.sample) < k:
            return np.full(len(x), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.nan_to_num(x @ self.sample.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        s[(ids[:, None] == self.sample_ids[None, :]) | ~probed[:, self.sample_lists]] = -np.inf
        return np.partition(s, len(self.sample) - k, axis=1)[:, len(self.sample) - k]

    def allowed(self, scores: np.ndarray, sizes: np.ndarray, band: int) -> np.ndarray:
        """Squared distance in a band beyond which a vector scores less, for queries of such norms."""
        with np.errstate(over="ignore", invalid="ignore"):
            return 2.0 - 2.0 * (scores / sizes / self.tops[band])


def fit_index(vectors: DataFrame, probe_share: float = 0.65, least_probes: int = 32, sample: int = SAMPLE) -> Index | None:
    """Fit on at most `sample` usable rows of vectors(vec_id, vector), those with the least hashes of their ids."""
    rows = vectors.select("vec_id", "vector", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id", "vector").limit(sample).collect()
    if not rows:
        return None
    width = Counter(len(r["vector"]) for r in rows).most_common(1)[0][0]
    rows = [r for r in rows if len(r["vector"]) == width]
    fitting = vectors.where(F.size("vector") == width)
    most = F.array_max(F.transform("vector", F.abs))
    norm = F.col("most") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most"))))
    sized = fitting.withColumn("most", most).select(norm.alias("norm"))
    bands = sized.groupBy(F.floor(F.log2("norm")).alias("b")).agg(F.max("norm").alias("top"), F.count("*").alias("n")).collect()
    distinct = not fitting.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return Index(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64), sorted((r["top"], r["n"]) for r in bands), distinct, probe_share, least_probes)


def column_blocks(turned: np.ndarray) -> list[np.ndarray]:
    """Turned vectors as blocks of COLUMNS dimensions, each of them contiguous."""
    return [np.ascontiguousarray(turned[:, a : a + COLUMNS]) for a in range(0, turned.shape[1], COLUMNS)]


def _stored(index: Index, grp: int, salt: int, ids: np.ndarray, lists: np.ndarray, x: np.ndarray) -> dict:
    """A row of BLOCKS: vectors in order of their lists, with the lists' radii in this block."""
    order = np.argsort(lists, kind="stable")
    ids, lists, x = ids[order], lists[order], x[order]
    turned, _ = index.turned(x)
    step = turned.astype(np.float64) - index.centroids[lists]
    far = np.sqrt(np.einsum("ij,ij->i", step, step))
    starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    blocks = b"".join(b.tobytes() for b in column_blocks(turned))
    return {"grp": grp, "salt": salt, "n": len(ids), "ids": ids.astype("<i8").tobytes(), "lists": lists.astype("<i4").tobytes(), "radii": np.maximum.reduceat(far, starts).astype("<f8").tobytes(), "x": x.astype("<f8").tobytes(), "turned": blocks}


def _gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at least HELD rows, but for the last."""
    ids, x, n = [], [], 0
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        x.append(_matrix(batch.column(1), width))
        n += batch.num_rows
        if n >= HELD:
            yield np.concatenate(ids), np.concatenate(x)
            ids, x, n = [], [], 0
    if n:
        yield np.concatenate(ids), np.concatenate(x)


DEALT = pa.schema([("grp", pa.int32()), ("salt", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("lists", pa.binary()), ("x", pa.binary())])
BLOCKS = pa.schema([*DEALT, ("radii", pa.binary()), ("turned", pa.binary())])


def blocks(vectors: DataFrame, index: Index) -> DataFrame:
    """All usable vectors in rows of BLOCKS of up to BLOCK."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every HELD vectors as small blocks of groups; they have one salt, by a hash of their ids."""
        index = shared.value
        for ids, x in _gathered(batches, index.width):
            lists = index.lists_of(*index.turned(x))
            salt = int(np.bitwise_xor.reduce(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % index.salts
            of = [(g, np.flatnonzero(lists % index.groups == g)) for g in np.unique(lists % index.groups)]
            out = [{"grp": int(g), "salt": salt, "n": len(r), "ids": ids[r].astype("<i8").tobytes(), "lists": lists[r].astype("<i4").tobytes(), "x": x[r].astype("<f8").tobytes()} for g, o in of for r in (o[i : i + BLOCK] for i in range(0, len(o), BLOCK))]
            yield pa.RecordBatch.from_pylist(out, schema=DEALT)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small blocks of one group and salt become larger ones; a partition has them in order."""
        index, held, key = shared.value, [], None

        def full() -> pa.RecordBatch:
            ids, lists, x = (np.concatenate([np.frombuffer(r[c], t) for r in held]) for c, t in (("ids", "<i8"), ("lists", "<i4"), ("x", "<f8")))
            return pa.RecordBatch.from_pylist([_stored(index, *key, ids, lists, x.reshape(-1, index.width))], schema=BLOCKS)

        for batch in batches:
            for row in batch.to_pylist():
                if held and (key != (row["grp"], row["salt"]) or sum(r["n"] for r in held) + row["n"] > BLOCK):
                    yield full()
                    held = []
                key = (row["grp"], row["salt"])
                held.append(row)
        if held:
            yield full()

    kind = "grp int, salt int, n int, ids binary, lists binary, x binary"
    dealt = bounded_batches(vectors).where(F.size("vector") == index.width).select("vec_id", "vector").mapInArrow(deal, kind)
    return dealt.repartition("grp", "salt").sortWithinPartitions("grp", "salt").mapInArrow(join_up, kind + ", radii binary, turned binary")


def query_batches(queries: DataFrame, index: Index, k: int, found: DataFrame | None = None) -> DataFrame:
    """(grp, nq, qids, q, bounds) of up to QUERIES queries that probe a list of the group: their nearest lists at first,
    then, given found(query_id, score) of the first k, the others."""
    shared = queries.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("grp", pa.int32()), ("nq", pa.int32()), ("qids", pa.binary()), ("q", pa.binary()), ("bounds", pa.binary())])
    rows, first = queries.where(F.size("vector") == index.width).select("vec_id", "vector"), found is None
    if not first:
        rows = rows.join(found.select(F.col("query_id").alias("vec_id"), "score"), "vec_id", "left").select("vec_id", "vector", "score")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                ids, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), index.width)
                q = index.queries(x)
                probed = index.probed(q, first)
                bounds = index.bounds(ids, x, probed, k + k // 2).astype("<f8")
                if not first:
                    bounds = np.fmax(bounds, part.column(2).to_numpy(zero_copy_only=False).astype(np.float64))
                out = []
                for g in range(index.groups):
                    of = np.flatnonzero(probed[:, g :: index.groups].any(axis=1))
                    if len(of):
                        out.append({"grp": g, "nq": len(of), "qids": ids[of].astype("<i8").tobytes(), "q": x[of].astype("<f8").tobytes(), "bounds": bounds[of].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(each, "grp int, nq int, qids binary, q binary, bounds binary")


def scan(q: list[np.ndarray], x: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the pairs that no test abandons; q and x are column blocks of turned vectors."""
    full = sum(b.shape[1] for b in q)
    alive = np.ones((len(bounds), len(x[0])), bool)
    partial = np.zeros(alive.shape, np.float32)
    qi = xi = sums = None
    b = 0
    for qb, xb in zip(q, x):
        b += qb.shape[1]
        if qi is None:
            partial += np.einsum("ij,ij->i", qb, qb)[:, None] + np.einsum("ij,ij->i", xb, xb)[None, :] - 2 * (qb @ xb.T)
        else:
            step = qb[qi] - xb[xi]
            sums += np.einsum("ij,ij->i", step, step)
        allowed = bounds * (1 + SLACK) + SLACK if b == full else bounds * (1 + EPSILON * np.sqrt((1 - b / full) / b)) ** 2 * (b / full) + SLACK
        if qi is None:
            alive &= partial <= allowed[:, None]
            if alive.mean() <= DENSE or b == full:
                qi, xi = np.nonzero(alive)
                sums = partial[qi, xi]
        else:
            keep = sums <= allowed[qi]
            qi, xi, sums = qi[keep], xi[keep], sums[keep]
        if qi is not None and not len(qi):
            break
    return qi, xi, sums


def _first_of(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of least value (then tie) of each group, in order."""
    order = np.lexsort((tie, value, group))
    starts = np.searchsorted(group[order], group[order], side="left")
    return order[np.arange(len(order)) - starts < k]


def meet_block(index: Index, block: dict, batch: dict, first: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score): up to k best of a block for each query of a batch that probes one of its lists."""
    ids, lists, radii = (np.frombuffer(block[c], t) for c, t in (("ids", "<i8"), ("lists", "<i4"), ("radii", "<f8")))
    qids, bounds = np.frombuffer(batch["qids"], "<i8"), np.frombuffer(batch["bounds"], "<f8").copy()
    x, q = np.frombuffer(block["x"], "<f8").reshape(-1, index.width), np.frombuffer(batch["q"], "<f8").reshape(-1, index.width)
    asking, columns, at = index.queries(q), [], 0
    for a in range(0, index.width + 1, COLUMNS):
        width = min(COLUMNS, index.width + 1 - a)
        columns.append(np.frombuffer(block["turned"], "<f4", len(ids) * width, at).reshape(-1, width))
        at += columns[-1].nbytes
    turned_q, far, sizes = column_blocks(asking), index.distances(asking), norms(q)
    probed = index.probed(asking, first)
    best = np.full((len(qids), k), -np.inf)
    found_q, found_x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    edges = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
    for a, b, radius in zip(edges, edges[1:], radii):
        band = index.of_band[lists[a]]
        allowed = index.allowed(bounds, sizes, band)
        near = np.maximum(far[:, lists[a]] - radius, 0) ** 2 <= allowed * (1 + SLACK) + SLACK
        who = np.flatnonzero(probed[:, lists[a]] & near)
        if not len(who):
            continue
        qi, xi, d = scan([c[who] for c in turned_q], [c[a:b] for c in columns], allowed[who])
        qi, xi = who[qi], a + xi
        other = qids[qi] != ids[xi]
        qi, xi, d = qi[other], xi[other], d[other]
        found_q.append(qi)
        found_x.append(xi)
        # The k-th best so far bounds the lists to come, as long as the block names each vector once.
        if index.distinct and len(qi):
            some = _first_of(qi, d, xi, k)
            rank = np.arange(len(some)) - np.searchsorted(qi[some], qi[some], side="left")
            more = np.full((len(qids), k), -np.inf)
            with np.errstate(over="ignore"):
                more[qi[some], rank] = (1 - 0.5 * d[some] - SLACK) * sizes[qi[some]] * index.tops[band]
            best = np.partition(np.concatenate([best, more], axis=1), k, axis=1)[:, k:]
            bounds = np.maximum(bounds, best.min(axis=1))
    qi, xi = np.concatenate(found_q), np.concatenate(found_x)
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[qi[j : j + 65536]], x[xi[j : j + 65536]]) for j in range(0, len(qi), 65536)])
    some = _first_of(qi, -score, ids[xi], k)
    return qids[qi[some]], ids[xi[some]], score[some]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors(vec_id, vector) of largest inner product for each of queries(vec_id, vector)."""
    vectors = written(vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", "vector"), "vectors")
    spark = vectors.sparkSession
    index = fit_index(vectors, **options)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    asked = written(queries.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector")), "asked")
    stored = written(blocks(vectors, index), "lists")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def meetings(found: DataFrame | None) -> DataFrame:
        first = found is None

        def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in meet_block(shared.value, row, row, first, k)], schema=schema)

        batches = written(query_batches(asked, index, k, found), "queries").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(index.salts - 1))))
        met = stored.join(batches, ["grp", "salt"]).select("ids", "lists", "radii", "x", "turned", "qids", "q", "bounds").mapInArrow(meet, "query_id long, vec_id long, score double")
        return met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def ranked(best: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    early = written(ranked(meetings(None)), "early")
    late = meetings(early.where(F.col("rank") == k))
    return ranked(early.select("query_id", "vec_id", "score").union(late).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return search(rows, rows.where("vec_id % 20 = 0"), k=20)
