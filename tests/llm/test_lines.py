import hashlib
import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import lines as L

LEAST = L.LEAST["word"]
VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def within_one(a, b):
    """Whether one edit at most leads from a to b: what is left between their common start and end has one symbol at most."""
    if max(len(a), len(b)) < 100:
        return levenshtein(a, b) <= 1
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= 1


def brute(rows, least=LEAST, unit="word"):
    """{(id, text): kept line numbers}."""
    placed = []
    for d, text in rows:
        r = xxhash.xxh64_intdigest((text or "").encode(), 42)
        r = r - (1 << 64) if r >> 63 else r
        for at, line in enumerate(L.split_lines(text)):
            placed.append((((d is not None, d or 0), r, at), d, text, at, L.symbols(line, unit)))
    placed.sort(key=lambda x: x[0])
    kept = {}
    for i, (place, d, text, at, words) in enumerate(placed):
        earlier = [o[4] for o in placed[:i] if o[0] != place]
        near = len(words) >= least
        gone = words and any(o == words or (near and len(o) >= least and within_one(o, words)) for o in earlier if o)
        if not gone:
            kept.setdefault((d, text), set()).add(at)
    return kept


def texts(rng, n):
    pool = [[rng.choice(VOCAB) for _ in range(rng.randint(1, 14))] for _ in range(12)]
    out = []
    for _ in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(words))
                what = rng.random()
                words = words[:at] + ([rng.choice(VOCAB)] if what < 0.4 else [] if what < 0.7 else [words[at], rng.choice(VOCAB)]) + words[at + 1 :] or ["x"]
            lines.append("  ".join(words) if rng.random() < 0.2 else " ".join(words))
            if rng.random() < 0.2:
                lines.append("")
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 2 if i < 6 else i, t) for i, t in enumerate(texts(rng, 40))]
    rows += [(None, rows[3][1]), (900, None), (901, ""), (902, rows[5][1]), rows[7], (903, " ".join(VOCAB * 3000)), (904, " ".join(VOCAB * 3000 + ["more"]))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, d string").repartition(3)
    want = brute(rows)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_kept"], r["text"]) for r in L.dedup_lines(df).collect()), key=str)
    expected = []
    for d, text in rows:
        lines, keep = L.split_lines(text), want.get((d, text), set())
        left = [x for i, x in enumerate(lines) if i in keep]
        expected.append((d, len(lines), len(left), b"\n".join(left).decode()))
    assert got == sorted(expected, key=str)


@pytest.mark.parametrize("least", [1, 2, 3, 5, 8])
def test_short_lines_against_brute_force(spark, least):
    """least is honoured below 8 words, between 7 and 8 words too."""
    rows = list(enumerate(texts(random.Random(least), 60)))
    rows += [(100, "p q r s t u v"), (101, "p q r s t u v w"), (102, "one two three"), (103, "one two four"), (104, "one two"), (105, "one"), (106, "two one two"), (107, "one two three four")]
    want = brute(rows, least)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(df, least=least).collect()}
    assert got == {d: b"\n".join(x for i, x in enumerate(L.split_lines(t)) if i in want.get((d, t), set())).decode() for d, t in rows}
    assert (got[101] == "") == (least <= 7) and (got[103] == "") == (least <= 3)


def kept(rows, want):
    return {d: b"\n".join(x for i, x in enumerate(L.split_lines(t)) if i in want.get((d, t), set())).decode() for d, t in rows}


@pytest.mark.parametrize("mask", [7, 255])
def test_equal_hashes_of_different_variants_lose_nothing(spark, monkeypatch, mask):
    """Keys of 3 and 8 bits: heads of a key are mostly no near lines, and hide those that are."""
    rows = list(enumerate(texts(random.Random(mask), 40)))
    emit = L.variants
    monkeypatch.setattr(L, "variants", _Masked(emit, mask))
    seen = []
    monkeypatch.setattr(L, "_by_variants", lambda *a, again=L._by_variants: seen.append(1) or again(*a))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == kept(rows, brute(rows)) and seen


class _Masked:
    """Goes to the workers with the function that refers to it."""

    def __init__(self, emit, mask):
        self.emit, self.mask = emit, mask

    def __call__(self, words):
        return self.emit(words) & self.mask


def test_characters_against_brute_force(spark):
    rng = random.Random(12)
    pool = ["the quick brown fox", "a lazy dog sleeps", "ünïcode 😀 line"]
    rows = []
    for i in range(60):
        line = list(rng.choice(pool))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(line))
            line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        rows.append((i, "".join(line) + "\n" + rng.choice(pool)[: rng.randint(1, 9)]))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), unit="character").collect()}
    assert got == kept(rows, brute(rows, L.LEAST["character"], "character"))


def test_short_near_lines_go_by_default(spark):
    df = spark.createDataFrame([(1, "sign up for news"), (2, "sign up for offers"), (3, "ok"), (4, "no")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_kept"] for r in L.dedup_lines(df).collect()} == {1: 1, 2: 0, 3: 1, 4: 1}


@settings(deadline=None)
@given(st.lists(st.sampled_from(VOCAB), min_size=1, max_size=12), st.integers(0, 11), st.integers(0, 2))
def test_halves_of_short_near_lines_meet(words, at, kind):
    at %= len(words)
    other = words[:at] + [["new"], [], [words[at], "new"]][kind] + words[at + 1 :]
    if other:
        enc = lambda x: [w.encode() for w in x]
        assert set(L.half_keys(enc(words))) & set(L.half_keys(enc(other)))


@settings(deadline=None)
@given(st.lists(st.sampled_from(VOCAB), min_size=1, max_size=12), st.lists(st.sampled_from(VOCAB), min_size=1, max_size=12))
def test_variants_meet_exactly_at_one_edit(a, b):
    va, vb = (L.variants([w.encode() for w in x]).tolist() for x in (a, b))
    if len(a) == len(b):
        meet = a == b or any(x == y for x, y in zip(va[:-1], vb[:-1]))
    else:
        meet = abs(len(a) - len(b)) == 1 and (va[-1] in vb[:-1] or vb[-1] in va[:-1])
    assert meet == (levenshtein(a, b) <= 1)
    assert L.edit_distance(a, b, 1) == min(2, levenshtein(a, b))
    assert L.edit_distance(a, b, 3) == min(4, levenshtein(a, b))


@settings(deadline=None)
@given(st.lists(st.sampled_from(VOCAB), min_size=8, max_size=40), st.integers(0, 39), st.integers(0, 2))
def test_halves_of_near_lines_meet(words, at, kind):
    at %= len(words)
    other = words[:at] + [["new"], [], [words[at], "new"]][kind] + words[at + 1 :]
    if len(other) >= LEAST:
        enc = lambda x: [w.encode() for w in x]
        assert set(L.half_keys(enc(words))) & set(L.half_keys(enc(other)))


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "same line\nother"), (2, "same line\n\nnew")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in L.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (2, 2, hashlib.sha256(b"same line\nother").hexdigest()), 2: (3, 2, hashlib.sha256(b"\nnew").hexdigest())}


def test_empty(no_docs):
    assert L.dedup_lines(no_docs).count() == 0
