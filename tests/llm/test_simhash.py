import random

import pytest
from pyspark.sql import functions as F

from runloom.llm import simhash as S
from runloom.llm.components import connected_components


def brute(fps, bits):
    """Least id reachable for rows (id, fp)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i][1] ^ fps[j][1]) & (2**64 - 1)).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {(d, fp): least.get(find(i)) for i, (d, fp) in enumerate(fps)}


def test_fingerprint_matches_spark_hashes(spark):
    text = "A bb Ccc dd É e ff"
    w = text.replace("A", "a").replace("C", "c").split()
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hashes = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert S.fingerprint(text, 3) & (2**64 - 1) == want
    assert S.fingerprint(None, 3) == S.fingerprint(" \n", 3) == 0
    assert S.fingerprint("one two", 3) & (2**64 - 1) == spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0] & (2**64 - 1)


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(1)
    text = " ".join(str(rng.randint(0, 9)) for _ in range(500))
    whole = S.fingerprint(text, 3)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint(text, 3) == whole


def test_rows_against_brute_force(corpus):
    rows, df = corpus
    want = brute([(r[0], S.fingerprint(r[1], 3)) for r in rows], 2)
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in S.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    for d, fp, c in got:
        assert want[(d, fp - (1 << 64) if fp >> 63 else fp)] == c


def test_hot_fingerprints_join_apart(corpus, monkeypatch):
    _, df = corpus
    plain = sorted(map(str, S.near_duplicates(df).collect()))
    monkeypatch.setattr(S, "HOT", 1)
    assert sorted(map(str, S.near_duplicates(df).collect())) == plain


def test_query(spark, corpus, tmp_path):
    corpus[1].write.parquet(f"{tmp_path}/documents.parquet")
    out = S.op10_simhash_near_dedup(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")] and out.count() == len(corpus[0])
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in out.collect())


@pytest.mark.parametrize("limit", [256, 3])
@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_lose_nothing(spark, limit, bits):
    """With few bits that vary, buckets are crowded: both ways must give the same components."""
    rng = random.Random(bits)
    fps = sorted({(0xABCD << 40) ^ sum(1 << rng.randint(0, 63) for _ in range(rng.randint(0, 4))) for _ in range(60)})
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(S.links(df, bits, limit)).collect()}
    want = brute([(f, f) for f in fps], bits)
    for f in fps:
        assert roots.get(f, f) == want[(f, f)]


def test_components_of_a_path_and_nulls(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (None, 3), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_empty(no_docs):
    assert S.near_duplicates(no_docs).count() == 0
