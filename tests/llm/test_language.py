import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import language as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "ver"], "cc": ["ción", "que", "ñ", "aje"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randint(3, 80)), lang, "x") for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(500, None, "aa", "x"), (501, "", "aa", "x"), (502, "123 --- !!", "bb", "x"), (503, text(rng, "aa", 3000), None, "x"), (None, text(rng, "bb", 30), "bb", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b", "c"], 4)
    codes, labels = rng.integers(0, 256, (7, 5)), np.array([0, 1, 2, 1, 0])
    codes[5:, 0] = L.PAD
    _, g = net.gradients(codes, labels)
    for name, w in net.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name == "input":
                at = (at[0], at[1], int(codes[2, 1]))
            old, e = w[at], 1e-5
            w[at] = old + e
            up = net.gradients(codes, labels)[0]
            w[at] = old - e
            down = net.gradients(codes, labels)[0]
            w[at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[name][at], abs=1e-7)


def test_compiled_labels_every_position_like_the_network():
    rng = np.random.default_rng(1)
    net = L.Network(["a", "b", "c"])
    data = bytes(rng.integers(0, 256, 2 * L.WINDOW + 7, dtype=np.uint8))
    codes = L.windows_of(data)
    assert codes.shape == (3, L.WINDOW + 2 * L.MARGIN)
    p, _ = net.forward(codes.T)
    want = (p * (codes.T != L.PAD)[:, None, :])[L.MARGIN : -L.MARGIN].sum(axis=0).T
    assert np.allclose(net.compiled().window_sums(codes), want, atol=1e-3)


def test_windows_see_the_text_around_them():
    data = bytes(range(256)) * 3
    rows = L.windows_of(data)
    for i, row in enumerate(rows):
        at = i * L.WINDOW - L.MARGIN
        assert row.tolist() == [data[j] if 0 <= j < len(data) else L.PAD for j in range(at, at + len(row))]
    assert np.array_equal(np.concatenate([L.windows_of(data, 0, 2 * L.WINDOW), L.windows_of(data, 2 * L.WINDOW)]), rows)


def test_no_letter_is_labelled_without_its_context():
    """A letter of two bytes across a window's end counts as within one: the labels of a text hardly depend on where windows begin."""
    rng = random.Random(6)
    net = L.Network(["a", "b"]).compiled()
    long = text(rng, "cc", 4000)
    (_, a), (_, b) = L.label_texts(net, [long, " " * 50 + long])
    assert a == pytest.approx(b, abs=2e-3)


def test_held_out_accuracy_and_defined_cases(corpus):
    rows, df = corpus
    net = L.fit(df.where(~L.held_out(F.col("doc_id"))), steps=120)
    got = {r["doc_id"]: r for r in L.predict(df, net).collect()}
    assert len(got) == len(rows) and net.languages == list(SYLLABLES)
    for i in (500, 501, 502):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[503]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    out = [r for r in rows[:180] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in out) / len(out) > 0.95


def test_a_long_text_is_the_mean_of_all_its_windows(monkeypatch):
    rng = random.Random(2)
    net = L.Network(["a", "b"]).compiled()
    one = text(rng, "aa", 900)
    whole = L.label_texts(net, [one, "x", None, one])
    monkeypatch.setattr(L, "LANES", 3)
    again = L.label_texts(net, [one, "x", None, one])
    assert [a[0] for a in whole] == [a[0] for a in again]
    assert [a[1] for a in whole] == pytest.approx([a[1] for a in again], abs=1e-5)


def test_held_out_rule(spark):
    got = spark.range(200).select("id", L.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_the_sample_is_bounded_and_never_empty(spark):
    """Languages of many rows, of few, and of one row repeated; ids null or equal."""
    rows = [(None, f"text {i}", "many") for i in range(3000)] + [(7, f"some {i}", "few") for i in range(5)] + [(1, "the same", "copied")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = L.sampled(df, "doc_id", "text", "lang", 50, 2).groupBy("lang").count().collect()
    assert dict(map(tuple, got)) == {"many": 50, "few": 5, "copied": 1}
    again = L.sampled(df.repartition(3), "doc_id", "text", "lang", 50, 2).collect()
    assert set(map(str, again)) == set(map(str, L.sampled(df, "doc_id", "text", "lang", 50, 2).collect()))


def test_predictions_are_those_of_the_plain_recurrence(spark, corpus):
    """Brute force: the recurrence byte by byte in double precision over each whole text, without windows."""
    rows, df = corpus
    net = L.fit(df, steps=60)
    n = net.hidden

    def states(codes, way):
        h, out = np.zeros(n), []
        for c in codes if way == 0 else codes[::-1]:
            a, u = net.input[way][:, c].astype(float), net.state[way].astype(float) @ h
            z, r = ((1 + np.tanh(a[i * n : (i + 1) * n] + u[i * n : (i + 1) * n])) / 2 for i in (0, 1))
            new = np.tanh(a[2 * n :] + r * u[2 * n :])
            h = z * h + (1 - z) * new
            out.append(h)
        return np.array(out if way == 0 else out[::-1])

    got = {r["doc_id"]: r for r in L.predict(df, net).collect()}
    for i, t, _, _ in rows[:40]:
        codes = np.frombuffer(t.encode(), np.uint8)
        logits = np.concatenate([states(codes, 0), states(codes, 1)], axis=1) @ net.out.astype(float).T + net.bias[:, 0]
        p = np.exp(logits)
        mean = (p / p.sum(axis=1, keepdims=True)).mean(axis=0)
        assert got[i]["lang_pred"] == net.languages[int(mean.argmax())] and got[i]["score"] == pytest.approx(mean.max(), abs=5e-3)


def test_query(spark, corpus, tmp_path):
    rows, df = corpus
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = L.op9_language_id(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = out.collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"und", *SYLLABLES}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(empty) is None and L.predict(empty, None).count() == 0
    some = spark.createDataFrame([(1, "text", None)], empty.schema)
    assert [r["lang_pred"] for r in L.predict(some, L.fit(some)).collect()] == ["und"]
