"""The audit against plain loops over all rows and orders."""

import itertools
import random
import re

import pytest

from runloom.llm import audit

LABEL = "doc_id long, quality int, toxic int"
COLUMNS = [x.split()[0] for x in audit.RESULT.split(", ")]


def fails(rows, doc):
    own, text, *_ = doc
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": own is not None and any(r[0] is not None and r[0] < own and (r[1] or "") == text for r in rows),
    }


def plain(rows, labels):
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    known = [(r[2] or "", fails(rows, r), r[0] in good, r[0] in toxic) for r in rows]
    out = []
    for part in {x[0] for x in known}:
        mine = [x for x in known if x[0] == part]
        taken = {}
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                redundant = sum(x[1][letter] for x in mine) - len(gone)
                alone = sum(x[1][letter] and sum(x[1].values()) == 1 for x in mine)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, alone, sum(x[2] for x in gone), sum(x[3] for x in gone), letter])
                taken[letter] = taken.get(letter, 0) + len(gone)
        for row in out:
            if row[0] == part:
                row[-1] = taken[row[-1]]
    return sorted(map(tuple, out))


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def cases(corpus):
    rng = random.Random(3)
    rows = list(corpus[0])
    some = ["LOUD WORDS " * 80, "a | b # c", " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i}" for i in range(150)) + " $", "é" * 9 + "A", "é" * 10 + "AB", "x " * 99, "x " * 100]
    rows += [(400 + i, rng.choice(some), rng.choice(["en", "fr", None, ""]), None, 0) for i in range(60)]
    rows += [(None, some[0], "en", None, 0), (7, some[2], "de", None, 0), (7, some[3], "de", None, 0), (7, some[3], "de", None, 0)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows[::2]] + [(400, 1, 0), (400, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, cases, corpus):
    return spark.createDataFrame(cases[0], corpus[1].schema).repartition(5), spark.createDataFrame(cases[1], LABEL)


def test_every_count_is_that_of_plain_loops(cases, tables):
    assert found(audit.filter_audit(*tables)) == plain(*cases)


def test_fingerprints_that_collide_change_nothing(cases, tables):
    assert found(audit.filter_audit(*tables, fingerprint_bits=1)) == plain(*cases)


def test_chains_let_go_of_their_texts_and_lose_none():
    rng = random.Random(1)
    rows = [(x % 3, (rng.randrange(50), f"text {x}".encode())) for x in (rng.randrange(9) for _ in range(400))]
    least = {}
    for fp, (own, text) in rows:
        least[text] = min(own, least.get(text, own))
    want = {(own, audit._digest(text)) for _, (own, text) in rows if own > least[text]}
    for held in (0, 20, 1e9):
        parts = [list(audit.chained(rows[i::4], held)) for i in range(4)]
        ended = list(audit.chained(itertools.chain(*parts), float("inf")))
        assert {(v[0], v[2]) for _, v in ended if len(v) == 3} == want
        assert sorted((v[1], v[0]) for _, v in ended if len(v) == 2) == sorted(least.items())


def test_empty_and_wide_tables(spark, no_docs, tables):
    docs, labels = tables
    assert audit.filter_audit(no_docs, labels).collect() == []
    wide = docs.selectExpr("*", "1 AS part", "2 AS fp", "3 AS bits", "4 AS copy", "5 AS mask", "6 AS good", "7 AS digest", "8 AS `a.b`")
    assert found(audit.filter_audit(wide, labels.limit(0))) == found(audit.filter_audit(docs, labels.limit(0)))


def test_query(spark, tmp_path, cases, tables):
    for name, df in zip(("documents", "labels"), tables):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert found(audit.op12_filter_audit(spark, str(tmp_path))) == plain(*cases)
