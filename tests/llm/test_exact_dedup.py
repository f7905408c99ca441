import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import exact_dedup as E
from runloom.llm.common import LOWER_AZ


def test_against_brute_force(corpus):
    rows, df = corpus
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode().translate(LOWER_AZ)].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    got = [tuple(r) for r in E.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(no_docs):
    assert E.exact_groups(no_docs).count() == 0


fingerprints = st.lists(st.integers(0, 2**64 - 1) | st.sampled_from([0, 1, 2**63, 2**64 - 1, 5 << 40]), max_size=60)


@settings(deadline=None)
@given(fingerprints, fingerprints, st.sampled_from([1, 8, 24, 32]), st.integers(0, 1))
def test_filter_round_trip_and_merge(a, b, bits, cut):
    make = lambda x: E.CountingQuotientFilter.build(np.array(x, np.uint64), bits)
    for x in (a, b):
        back = E.CountingQuotientFilter.load(make(x).dump())
        assert back.fingerprints.tolist() == sorted(set(x)) and back.counts.tolist() == [x.count(v) for v in sorted(set(x))]
        assert all(make(x).count(v) == x.count(v) for v in [*a, *b, 3, 2**63 + 1])
    merged = make(a).merge(make(b))
    again = make(a + b)
    for part in ("runs", "ends", "remainders", "counts"):
        assert getattr(merged, part).tolist() == getattr(again, part).tolist()
    assert merged.fingerprints.tolist() == sorted(set(a + b)) and merged.counts.tolist() == [(a + b).count(v) for v in sorted(set(a + b))]
    parts = [E.CountingQuotientFilter.load(d) for _, d in merged.segments(cut)]
    assert [v for p in parts for v in p.fingerprints.tolist()] == merged.fingerprints.tolist()


def test_segments_find_all_repeats(spark):
    values = [(i * 0x9E3779B97F4A7C15 + 1) % 2**64 - 2**63 for i in range(500)] * 2 + [7, -7]
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(6)
    got = {r["fp"]: r["n"] for r in E.repeated_fingerprints(df, 50 * E.SEGMENT).collect()}
    assert got == {v: 2 for v in values[:500]}


def test_query(spark, corpus, tmp_path):
    corpus[1].write.parquet(f"{tmp_path}/documents.parquet")
    out = E.op4_exact_dedup(spark, str(tmp_path))
    assert out.dtypes[:5] == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    assert out.count() == len(corpus[0])


def test_long_texts_that_differ_at_their_ends(spark):
    long = "Wort " * 200_000
    df = spark.createDataFrame([(1, long + "a"), (2, long + "A"), (3, long + "b"), (4, long)], "doc_id long, text string")
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in E.exact_groups(df).collect()} == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
