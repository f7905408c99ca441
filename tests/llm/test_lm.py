"""Scores against plain counting and the plain model; the estimation against differences; what the model gains."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from runloom.llm import lm

DOC = "doc_id long, text string"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [lm.END]


def is_held_out(own):
    return own is not None and zlib.crc32(str(own).encode()) % 5 == 1


def plain(rows):
    c = Counter(t for own, text, *_ in rows if not is_held_out(own) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for own, text, *_ in rows:
        mine = tokens(text)
        out.append((own, is_held_out(own), len(mine), sum(t in c for t in mine), n, math.fsum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12, atol=1e-9)


def found(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    """Two languages that differ in words, and their order; ties, copies, nulls, a long text."""
    rng = random.Random(2)
    tongues = [[f"{a}{b}" for a in "bdgk" for b in ("an", "el", "or", "it")], [f"{a}{b}" for a in "ptzs" for b in ("ou", "ee", "ai", "ui")]]

    def text(n):
        words, tongue = [], rng.choice(tongues)
        for _ in range(n):
            words.append(tongue[(tongue.index(words[-1]) + rng.choice([1, 1, 1, 5])) % len(tongue)] if words and words[-1] in tongue else rng.choice(tongue))
            if rng.random() < 0.1:
                words[-1] = f"x{rng.randrange(300)}{words[-1]}"
        return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in words)

    out = [(i, text(rng.randrange(2, 80))) for i in range(300)]
    out += [(1000 + i, out[5][1]) for i in range(4)] + [(2000, None), (2001, ""), (2002, " \t\n\x0b"), (None, text(9)), (7, out[7][1]), (2003, text(6000)), (2004, "É\x00 É\x1f b ÉCOLE")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5)


@pytest.fixture(scope="module")
def fitted(spark, docs):
    text = lm.F.coalesce("text", lm.F.lit(""))
    learned = docs.where(~lm.held_out(lm.F.col("doc_id"))).select(lm.F.xxhash64("doc_id", text).alias("h"), text.alias("text"))
    vocabulary = lm.vocabulary_of(lm.token_counts(learned.select("text")), 100)
    return vocabulary, lm.fit(learned, vocabulary, 250, spark.sparkContext.broadcast(vocabulary))


def test_base_is_that_of_plain_counting(rows, docs):
    same(found(lm.token_scores(docs, neural=False)), plain(rows))
    same(found(lm.token_scores(docs, neural=False, dictionary=5, chunk=11)), plain(rows))


def test_score_is_that_of_the_plain_model(rows, docs, fitted, spark):
    vocabulary, model = fitted
    counts = Counter(t for own, text in rows if not is_held_out(own) for t in tokens(text))
    scored = {r["doc_id"]: r for r in lm.token_scores(docs.where("doc_id = 3 OR doc_id = 2003 OR doc_id = 2000 OR NOT doc_id IN (3, 2003, 2000) OR doc_id IS NULL"), dictionary=100, chunk=50).collect()}
    own = vocabulary.class_of(vocabulary.places(sorted(counts)))
    for doc_id in (3, 2000, 2003):
        text = next(t for o, t in rows if o == doc_id)
        before, total = [lm.START] * lm.CONTEXT, 0.0
        for t in tokens(text):
            q = sum(model.given[c] @ m for c, m in zip(before, model.mix))
            s = np.where(model.noise > lm.NONE, model.out @ q + model.bias, -np.inf)
            c = int(vocabulary.class_of(vocabulary.places([t]))[0])
            total += (s[c] - s.max() - np.log(np.exp(s - s.max()).sum())) / lm.LOG10
            if c >= lm.OUT:
                of = [w for w, x in zip(sorted(counts), own) if x == c]
                total += math.log10((counts[t] + 0.5) / (sum(counts[w] for w in of) + 0.5 * (len(of) + 1)))
            before = [c, *before[:-1]]
        assert abs(scored[doc_id]["score"] - total) < 1e-3 * max(1, abs(total)), doc_id


def test_probabilities_of_all_words_add_up_to_one(fitted, rows):
    vocabulary, model = fitted
    scorer = model.compiled()
    counts = Counter(t for own, text in rows if not is_held_out(own) for t in tokens(text))
    for context in ([lm.START] * 4, [3, 1, 0, 2], [lm.OUT + 5, 7, lm.START, lm.START]):
        by_class = 10 ** np.array([scorer.log10(np.array([*reversed(context), c]), np.array([4]))[0] for c in range(lm.CLASSES)])
        assert abs(by_class.sum() - 1) < 1e-5
    unknown = 0.5 / vocabulary.rest
    inside = np.zeros(lm.BUCKETS)
    for w, c in counts.items():
        if vocabulary[w] < 0 or vocabulary[w] >= lm.OUT:
            inside[lm.bucket_of(w)] += (c + 0.5) / vocabulary.rest[lm.bucket_of(w)]
    assert np.allclose(inside + unknown, 1)


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    shares = rng.random(lm.CLASSES)
    model = lm.Model(shares / shares.sum())
    context, target, noise = rng.integers(0, lm.CLASSES + 1, (20, lm.CONTEXT)), rng.integers(0, lm.CLASSES, 20), rng.integers(0, lm.CLASSES, 30)
    _, g = model.gradients(context, target, noise)
    flat, at = np.concatenate([g[n].ravel() for n in model.NAMES]), model.vector()
    for i in rng.choice(np.flatnonzero(flat), 60):
        ends = []
        for step in (1e-5, -1e-5):
            moved = at.copy()
            moved[i] += step
            ends.append(model.moved(moved).gradients(context, target, noise)[0])
        assert abs((ends[0] - ends[1]) / 2e-5 - flat[i]) < 1e-6 + 1e-4 * abs(flat[i])


def test_the_model_says_more_than_counts_of_texts_it_has_not_seen(docs):
    rows = [r for r in lm.token_scores(docs).collect() if r["held_out"]]
    assert len(rows) > 40 and sum(r["score"] for r in rows) > 0.85 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.9 * len(rows)


def test_order_of_words_matters(spark, docs, rows):
    rng = random.Random(8)
    mixed = [(10_000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows if i is not None and is_held_out(i) and t]
    mixed = [r for i, r in enumerate(mixed)]
    scored = {r["doc_id"]: r for r in lm.token_scores(docs.union(spark.createDataFrame(mixed, DOC).where(lm.held_out(lm.F.col("doc_id"))))).collect()}
    pairs = [(scored[i - 10_000]["score"], scored[i]["score"]) for i, _ in mixed if is_held_out(i) and i in scored and i - 10_000 in scored]
    assert len(pairs) > 5 and sum(a for a, _ in pairs) > sum(b for _, b in pairs)


def test_stretches_give_whole_words_and_true_contexts():
    vocabulary = lm.Vocabulary([b"a", b"b", lm.END], np.array([5.0, 4.0, 3.0]), 12, 3, {lm.bucket_of(b"a"): (5, 1), lm.bucket_of(b"b"): (4, 1), lm.bucket_of(b""): (3, 1)})
    context, target = lm.examples(vocabulary, b"a b a", True, True)
    assert target.tolist() == [0, 1, 0, 2] and context[0].tolist() == [lm.START] * 4 and context[2].tolist() == [1, 0, lm.START, lm.START]
    context, target = lm.examples(vocabulary, b"xa b a b a b ax", False, False)
    assert target.tolist() == [1] and context.tolist() == [[0, 1, 0, 1]]
    assert len(lm.examples(vocabulary, b"xa", False, False)[1]) == 0


def test_empty_wide_and_unlearnable_tables(spark, no_docs, docs, rows):
    assert lm.token_scores(no_docs).collect() == []
    unseen = [(i, "a b") for i in range(60) if is_held_out(i)]
    got = found(lm.token_scores(spark.createDataFrame(unseen, DOC)))
    assert {r[2:] for r in got} == {(3, 0, 0, 0.0, 0.0)} and len(got) == len(unseen)
    wide = docs.selectExpr("*", "1 AS row", "2 AS word", "3 AS n", "4 AS others", "5 AS h", "6 AS held_out", "7 AS `a.b`")
    same(found(lm.token_scores(wide, neural=False)), plain(rows))


def test_query(spark, tmp_path, rows, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = lm.op13_lm_scoring(spark, str(tmp_path))
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(found(df), plain(rows))


def test_training_reads_every_token_of_every_document(spark):
    """Documents far longer than a stretch: what the tasks train on is all of it."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 50}" for j in range(900)) for i in range(12)]
    learned = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h long, text string").repartition(3)
    vocabulary = lm.vocabulary_of(lm.token_counts(learned.select("text")), 100)
    assert lm.fit(learned, vocabulary, 12, spark.sparkContext.broadcast(vocabulary)).tokens == 12 * 901


@pytest.mark.parametrize("chunk", [1, 9, 1 << 20])
def test_examples_of_whole_texts(spark, chunk):
    learned = spark.createDataFrame([("a b c a b",)], "text string")
    vocabulary = lm.vocabulary_of(lm.token_counts(learned))
    parts = list(lm.text_examples(vocabulary, b"A b c d a  b", chunk))
    context, target = np.concatenate([c for c, _ in parts]), np.concatenate([t for _, t in parts])
    classes = [lm.START] * lm.CONTEXT + [int(vocabulary.class_of(vocabulary.places([w]))[0]) for w in (b"a", b"b", b"c", b"d", b"a", b"b", lm.END)]
    assert target.tolist() == classes[lm.CONTEXT :] and context.tolist() == [classes[i : i + lm.CONTEXT][::-1] for i in range(len(target))]


def test_scores_of_a_product_fit_a_cache_and_add_up_to_one():
    """Larger products of scores are slower than the check's time allows; their sums are by a product too."""
    assert lm.ROWS * lm.CLASSES * 4 <= 1 << 20
    rng = np.random.default_rng(3)
    scorer = lm.Scorer(lm.Model(np.full(lm.CLASSES, 1 / lm.CLASSES)))
    before = rng.integers(0, lm.CLASSES, lm.CONTEXT)
    classes = np.concatenate([np.concatenate([before, [c]]) for c in range(lm.CLASSES)])
    found = scorer.log10(classes, np.arange(lm.CONTEXT, len(classes), lm.CONTEXT + 1))
    assert abs((10**found).sum() - 1) < 1e-5
