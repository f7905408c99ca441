"""Phrases, their cuts and the first of each language against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import phrases


def plain(rows, max_n=4, least=30, held_in=80, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longest = {}
    for (lang, *words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, *words[i : i + k])
                longest[inner] = max(longest.get(inner, 0), a)
    out = {}
    for (lang, *words), a in found.items():
        if 100 * longest.get((lang, *words), -1) >= held_in * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    common = ["ka", "LO", "mi", "É", "\x01", "a\x00", "ka\x0e", "tu"]
    out = []
    for i in range(120):
        words = [rng.choice(common[: rng.choice([2, 8])]) if rng.random() < 0.8 else f"rare{rng.randrange(400)}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\r", "\x0b", "!?"]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "fr", None, "und"]), "s", 0))
    out += [(200 + i, "the same line comes again and again", "en", "s", 0) for i in range(40)]
    out += [(300, None, "en", "s", 0), (301, "", "fr", "s", 0), (None, "ka lo " * 3000, "en", "s", 0), (1, " .,\n", None, None, 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("options", [{}, {"least": 5, "top": 40}, {"least": 4, "chunk": 7, "gathered": 3}, {"least": 2, "max_n": 3}, {"least": 3, "max_n": 2}, {"least": 3, "max_n": 6}])
def test_rows_are_those_of_plain_counting(rows, docs, options):
    shown = {k: v for k, v in options.items() if k not in ("chunk", "gathered")}
    want = plain(rows, **shown)
    assert want and found(phrases.collocations(docs, **options)) == want


@pytest.mark.parametrize("bits", [63, 6])
def test_words_outside_the_dictionary_go_by_hash_and_equal_hashes_do_no_harm(rows, docs, bits):
    assert found(phrases.collocations(docs, least=4, dictionary=9 if bits == 63 else 1000 if bits < 6 else 450, hash_bits=bits)) == plain(rows, least=4)


def test_too_many_equal_hashes_are_an_error(docs):
    with pytest.raises(RuntimeError, match="equal hashes"):
        phrases.collocations(docs, least=1, dictionary=3, hash_bits=2)


@pytest.mark.parametrize("seed", range(4))
def test_counts_do_not_depend_on_where_ranges_and_batches_end(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 4, 3000)
    rows = phrases.suffixes(words, 4)
    want = Counter(tuple(r[:k]) + (0,) * (4 - k) for r in rows.tolist() for k in range(2, 5) if r[k - 1])
    cuts = phrases.quantiles(rows[::40], np.ones(len(rows[::40])), 5)
    part, own, n = phrases.merged(rows, cuts)
    got = Counter()
    for p in range(len(cuts) + 1):
        mine = np.concatenate([own[part == p], n[part == p][:, None]], axis=1)[::-1]
        names = ["w1", "w2", "w3", "w4", "n"]
        step = int(rng.integers(1, 9))
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in mine[i : i + step].T], names=names) for i in range(0, len(mine), step)]
        given = [r for b in phrases.prefix_counts(batches, 20) for r in b.to_pylist()]
        assert sum(r["n"] < 20 for r in given) <= 6
        for r in given:
            got[tuple(r[w] for w in names[:4])] += r["n"]
    assert {k: v for k, v in got.items() if v >= 20} == {k: v for k, v in want.items() if v >= 20}


def test_large_counts_are_exact(spark):
    wide = 3_000_000_000_000
    df = spark.createDataFrame([(wide, 2 * wide, wide + 1)], "a long, l long, r long")
    score = "(CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"
    assert df.selectExpr(f"{score} AS s").first()["s"] == 2000000 * wide // (3 * wide + 1)


def test_empty_and_wide_tables(spark, rows, docs, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(no_docs.union(spark.createDataFrame([(1, None, None, None, 0), (2, ".", "en", None, 0)], no_docs.schema))).collect() == []
    wide = docs.selectExpr("*", "1 AS word", "2 AS n", "3 AS id", "4 AS w1", "5 AS part", "6 AS phrase", "7 AS total", "8 AS `a.b`")
    assert found(phrases.collocations(wide)) == plain(rows)


def test_query(spark, tmp_path, rows, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert found(phrases.op11_phrase_collocations(spark, str(tmp_path))) == plain(rows)
