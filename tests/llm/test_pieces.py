import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runloom.llm import pieces as P

VOCABULARY = P.Vocabulary(P.read_model(P.MODEL))


def ids(text):
    return np.frombuffer(VOCABULARY.encode(text), "<i4").tolist()


def brute(text):
    """Viterbi over the whole text at once."""
    s, v = text, VOCABULARY
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        alone = False
        for i in range(max(0, j - 20), j):
            node = v.trie
            for c in s[i:j]:
                node = node[0].get(c)
                if node is None:
                    break
            if node and node[1] is not None:
                alone = alone or i == j - 1
                if best[i] + node[1] > best[j]:
                    best[j], back[j] = best[i] + node[1], (i, node[2])
        if not alone and best[j - 1] + v.unknown > best[j]:
            best[j], back[j] = best[j - 1] + v.unknown, (j - 1, v.spell(s[j - 1]))
    out, j = [], len(s)
    while j:
        j, part = back[j]
        out.append(part)
    return [i for part in reversed(out) for i in part]


TEXT = st.text(alphabet="the andionqu éß▁\n\t日😀\x00.xyz ", max_size=60)


@settings(deadline=None, max_examples=200)
@given(TEXT)
def test_best_path_and_round_trip(text):
    assert VOCABULARY.decode(ids(text)) == text
    if P.MARK not in text and text:
        assert ids(text) == brute(P.MARK + text.replace(" ", P.MARK))


def held(text):
    """Most links that are reachable at once while the search reads a stretch, and the ids."""
    import gc

    most, ids = 0, []
    for i, part in enumerate(VOCABULARY.stream(iter(text))):
        ids += part
        if i % 500 == 0:
            most = max(most, sum(type(x) is list and len(x) == 3 and type(x[0]) is int and type(x[1]) is tuple for x in gc.get_objects()))
    return most, ids


@pytest.mark.parametrize("alphabet", ["abcdeginorst", "ab", "日本", "the "])
def test_what_is_held_of_a_long_stretch_is_bounded(alphabet):
    rng = random.Random(4)
    text = P.MARK + ("ab" * 10_000 if alphabet == "ab" else "".join(rng.choice(alphabet.strip()) for _ in range(20_000)))
    most, ids = held(text)
    assert most < 200
    assert ids == brute(text)


def test_a_run_of_one_letter_is_undecided_to_its_end():
    """Ways that differ in where they begin never meet there; no id is given out before one of them has won."""
    text = P.MARK + "a" * 3000
    assert held(text)[1] == brute(text)


def test_ids_are_committed_long_before_the_end():
    text, read = "internationalisation" * 50, 0

    def chars():
        nonlocal read
        for read, c in enumerate(text, 1):
            yield c

    lag, done = 0, 0
    for part in VOCABULARY.stream(chars()):
        done += sum(len(VOCABULARY.bytes_of[i]) for i in part)
        lag = max(lag, read - done)
    assert done == len(text) and lag < 100


def test_remembered_stretches_do_not_change_ids(monkeypatch):
    text = "the cat sat on the mat and the cat sat again " * 5
    want = brute(P.MARK + text.replace(" ", P.MARK))
    monkeypatch.setattr(P, "REMEMBERED", 2)
    VOCABULARY.recent, VOCABULARY.older = {}, {}
    assert ids(text) == want == ids(text)


def test_scores_of_a_unigram_model_are_used_as_they_are():
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(P.read_model(P.MODEL))
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = -np.log(100.5 + i).item()
    raw = model.SerializeToString()
    mine, library = P.Vocabulary(raw), SentencePieceProcessor(model_proto=raw)
    words = "the quick brown fox jumps over a lazy dog while internationalization continues".split()
    assert sum(np.frombuffer(mine.encode(w), "<i4").tolist() == library.encode(w) for w in words) >= len(words) - 1


def test_rows(spark, no_docs):
    rows = [(1, "the end"), (2, None), (3, ""), (None, "▁ é"), (1, "the end"), (4, "word " * 30_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["text"]) for r in P.decode(P.encode(df)).collect()]
    assert sorted(got, key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert P.decode(P.encode(no_docs)).count() == 0


def settings_of(**changes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto.FromString(P.read_model(P.MODEL))
    for k, v in changes.items():
        setattr(model.normalizer_spec, k, v)
    return model.SerializeToString()


def test_settings_of_the_model_hold_or_are_refused():
    plain = P.Vocabulary(settings_of(add_dummy_prefix=False))
    got = np.frombuffer(plain.encode("the end"), "<i4").tolist()
    assert got == brute("the" + P.MARK + "end") and plain.decode(got) == "the end" and plain.decode(np.frombuffer(plain.encode(" x"), "<i4").tolist()) == " x"
    for change in ({"remove_extra_whitespaces": True}, {"escape_whitespaces": False}, {"precompiled_charsmap": b"abc"}):
        with pytest.raises(ValueError, match="changes texts"):
            P.Vocabulary(settings_of(**change))


def test_query(spark, corpus, tmp_path):
    rows, df = corpus
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.op7_sentencepiece(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_ids", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = sorted(hashlib.sha256((r[1] or "").encode()).hexdigest() for r in rows)
    assert sorted(r["decoded_sha256"] for r in out.collect()) == want


def test_a_piece_that_crosses_the_space_mark_is_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(P.read_model(P.MODEL))
    model.pieces[300].piece = "of▁the"
    with pytest.raises(ValueError):
        P.Vocabulary(model.SerializeToString())
