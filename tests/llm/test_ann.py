import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import ann

SCHEMA = "vec_id long, vector array<double>, score string"


def brute(rows, k, queries):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max({len(v) for _, v in good}, key=[len(v) for _, v in good].count) if good else 0
    good = [(i, v) for i, v in good if len(v) == width]
    out = {}
    for q, x in good:
        if q in queries:
            best = {}
            for i, v in good:
                if i != q:
                    best[i] = max(best.get(i, -1e9), float(x @ v))
            out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=12).tolist()) for i in range(400)]
    data += [(1000 + i, data[3][1]) for i in range(60)]  # one common vector: ties
    data += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, None] + [0.0] * 10), (2004, [float("nan")] * 12), (2005, [float("inf")] * 12), (2006, [1.0] * 5), (None, data[0][1]), (40, data[40][1])]
    return data


def frames(spark, rows):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(4)
    return df, df.where("vec_id % 20 = 0")


def test_exact_when_every_list_is_probed(spark, rows):
    df, asked = frames(spark, rows)
    got = ann.search(df, asked, k=7, probe_share=1.0).collect()
    want = brute(rows, 7, {i for i, _ in rows if i is not None and i % 20 == 0})
    assert {r["query_id"] for r in got} == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert sorted(mine, key=lambda m: (-m[2], m[1])) == mine
        hits += len({m[1] for m in mine} & {i for _, i in best})
        truth = {i: -s for s, i in best}
        assert all(m[2] == pytest.approx(truth[m[1]], abs=1e-12) for m in mine if m[1] in truth)
    assert hits / sum(map(len, want.values())) > 0.97


@pytest.mark.parametrize("kind", ["clustered", "unclustered", "one of norm 1e4", "one of norm 1e20", "lognormal", "far apart"])
def test_recall_at_production_settings(spark, kind):
    """More lists than are probed; clustered vectors and such of no structure at all; norms that differ."""
    rng = np.random.default_rng(8)
    n, width = 3600, 24
    x = rng.normal(size=(n, width))
    if kind == "clustered":
        x = 4 * rng.normal(size=(60, width))[rng.integers(0, 60, n)] + x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind.startswith("one"):
        x[7] *= float(kind.split()[-1])
    elif kind == "lognormal":
        x *= np.exp(rng.normal(size=n))[:, None]
    elif kind == "far apart":
        x *= 10.0 ** rng.choice([-30, 0, 30], n)[:, None]
    df, asked = frames(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    index = ann.fit_index(df.select("vec_id", "vector"))
    assert kind == "lognormal" or sum(index.probes) < len(index.centroids)  # bands of few lists are probed whole
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, n, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, row in enumerate(score) for i in np.argsort(-row, kind="stable")[:20]}
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, asked, k=20).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_salts_and_first_lists_lose_nothing(spark, rows, monkeypatch):
    """Many salts and several meetings a query: with every list probed and no abandoning, the result is exact."""
    monkeypatch.setattr(ann, "SALTED", 2)
    monkeypatch.setattr(ann, "EPSILON", 50.0)
    df, asked = frames(spark, rows)
    assert ann.fit_index(df.where(ann.usable(F.col("vector")) & F.col("vec_id").isNotNull()).select("vec_id", "vector")).salts > 3
    got = ann.search(df, asked, k=7, probe_share=1.0).collect()
    want = {(q, i): -s for q, best in brute(rows, 7, {i for i, _ in rows if i is not None and i % 20 == 0}).items() for s, i in best}
    assert {(r["query_id"], r["vec_id"]) for r in got} == set(want)


def test_meetings_bound_later_lists(spark):
    """What is found tightens the bound: of far lists, hardly a vector is looked at (clustered vectors)."""
    rng = np.random.default_rng(3)
    centres = 20 * rng.normal(size=(16, 12))
    x = centres[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 12))
    index = ann.Index(np.arange(2000), x, [(float(ann.norms(x).max()), 2000)], True, 1.0, 32)
    lists = index.lists_of(*index.turned(x))
    block = ann._stored(index, 0, 0, np.arange(2000), lists, x)
    seen = []
    scan = ann.scan
    ann.scan = lambda q, x, b: seen.append(len(q[0]) * len(x[0])) or scan(q, x, b)
    try:
        batch = {"qids": np.arange(50).astype("<i8").tobytes(), "q": x[:50].tobytes(), "bounds": np.full(50, -np.inf).tobytes()}
        index.probed = lambda q, first: np.ones((len(q), len(index.centroids)), bool)
        ann.meet_block(index, block, batch, False, 5)
        loose = sum(seen)
        seen.clear()
        exact = x[:50] @ x.T
        exact[np.arange(50), np.arange(50)] = -np.inf
        batch["bounds"] = np.sort(exact, axis=1)[:, -5].tobytes()
        ann.meet_block(index, block, batch, False, 5)
    finally:
        ann.scan = scan
    assert sum(seen) < loose < 50 * 2000


def test_bands_that_are_too_short_are_left_out():
    """By Cauchy and Schwarz: once enough long vectors are found, no list of short ones is looked at."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:200] = np.abs(x[:200]) * 1e6
    index = ann.Index(np.arange(600), x, [(float(ann.norms(x[200:]).max()), 400), (float(ann.norms(x[:200]).max()), 200)], True, 1.0, 32)
    bound, size = np.array([1e5]), ann.norms(x[:1])
    assert index.allowed(bound, np.array([1.0]), 0)[0] < 0 < index.allowed(bound, np.array([1.0]), 1)[0]
    assert set(index.turned(x)[1][:200]) == {1} and set(index.turned(x)[1][200:]) == {0} and size > 1e5


def test_norms_keep_to_the_range_of_doubles():
    x = np.array([[3e200, 4e200], [3e-200, 4e-200], [0.0, 0.0], [3.0, 4.0]])
    assert np.allclose(ann.norms(x), [5e200, 5e-200, 0, 5], rtol=1e-12)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(200)] + [(400, None), (420, [0.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = ann.op2_nearest_neighbours(spark, str(tmp_path))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = out.collect()
    assert {r["query_id"] for r in got} == set(range(0, 200, 20)) and len(got) == 10 * 20


def test_few_and_none(spark):
    df, asked = frames(spark, [(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [-1.0, 0.0])])
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, asked, k=20).orderBy("rank").collect()]
    assert got == [(1, 21, 0.5), (2, 22, -1.0)]
    df, asked = frames(spark, [(20, None)])
    assert ann.search(df, asked).count() == 0


def test_abandoning_keeps_near_candidates():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(3000, 48)).astype(np.float32), rng.normal(size=(20, 48)).astype(np.float32)
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    bound = np.sort(d, axis=1)[:, 19].astype(float)
    qi, xi, dist = ann.scan(ann.column_blocks(q), ann.column_blocks(x), bound)
    assert np.allclose(dist, d[qi, xi], rtol=1e-3)
    found = set(zip(qi.tolist(), xi.tolist()))
    true = set(zip(*np.nonzero(d <= bound[:, None])))
    assert len(found & true) / len(true) > 0.97 and len(found) < 1.1 * len(true)
