"""Each stage of the pipeline against a brute-force version on its own input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from runloom.llm import exact_dedup, language, pieces, simhash

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ei", "ung", "ver"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    text = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text("aa" if i % 2 else "bb", rng.randint(20, 90)), "aa" if i % 2 else "bb", f"s{i % 5}", 0) for i in range(150)]
    rows += [(200 + i, rows[i][1].upper(), rows[i][2], "s0", 0) for i in range(10)]
    rows += [(300 + i, rows[20 + i][1] + " ka", "aa", "s1", 0) for i in range(12)]
    rows += [(400, None, "aa", "s1", None), (401, "", "aa", "s1", 0), (402, "12 34 !!", "aa", "s1", 0), (403, text("aa", 4000), None, None, None), (None, text("bb", 30), "bb", "s2", 0)]
    out = tmp_path_factory.mktemp("docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    return str(out)


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").persist()
    out = [docs]
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder).persist()
        out.append(docs)
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_but_the_last_have_the_columns_of_documents(steps):
    assert [d.columns for d in steps[:-1]] == [steps[0].columns] * 5
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "sentencepiece"]


def test_language_stage_drops_only_what_has_no_language(steps):
    network = language.fit(steps[0].where(~language.held_out(F.col("doc_id"))))
    label = language.label_texts(network, [r["text"] for r in steps[0].collect()])
    want = Counter(tuple(r) for r, (name, p) in zip(steps[0].collect(), label) if name != "und" and p >= P.LEAST_SCORE)
    assert rows(steps[1]) == want
    gone = {r["doc_id"] for r in steps[0].collect()} - {r["doc_id"] for r in steps[1].collect()}
    assert gone == {400, 401, 402}


def test_exact_stage(steps):
    best = {}
    for r in steps[1].collect():
        key = exact_dedup.normalised(r["text"])
        best[key] = max(best.get(key, -1), r["doc_id"] if r["doc_id"] is not None else -1)
    want = Counter(tuple(r) for r in steps[1].collect() if best[exact_dedup.normalised(r["text"])] in (r["doc_id"], -1))
    assert rows(steps[2]) == want and sum(want.values()) == sum(rows(steps[1]).values()) - 10


def test_near_stage(steps):
    docs = steps[2].collect()
    fps = [simhash.fingerprint(r["text"], 3) for r in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for r, g in zip(docs, group):
        if r["doc_id"] is not None:
            least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    assert rows(steps[3]) == Counter(tuple(r) for r, g in zip(docs, group) if r["doc_id"] == least.get(g))


def test_mixing_stage_copies_rows_to_the_targets(steps):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    before, after = Counter(), Counter()
    for r in steps[3].collect():
        before[r["source"]] += size(r)
    for r in steps[4].collect():
        after[r["source"]] += size(r)
    assert max(Counter(r["doc_id"] for r in steps[4].collect()).values()) == 2
    largest = Counter()
    for r in steps[3].collect():
        largest[r["source"]] = max(largest[r["source"]], size(r))
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= sum(largest.values())
    assert all(n <= 2 * before[s] for s, n in after.items())
    assert set(rows(steps[4])) <= set(rows(steps[3]))


def test_last_stage_encodes_every_row(steps):
    vocabulary = pieces.Vocabulary(pieces.read_model(pieces.MODEL))
    texts = Counter((r["doc_id"], r["text"]) for r in steps[4].collect())
    got = Counter((r["doc_id"], vocabulary.decode(r["ids"])) for r in steps[5].collect())
    assert got == texts and all(r["n_ids"] == len(r["ids"]) for r in steps[5].collect())


def test_run_is_the_stages_in_order(spark, folder, steps):
    key = lambda r: (r["doc_id"], tuple(r["ids"]))
    assert Counter(map(key, P.run(spark, folder).collect())) == Counter(map(key, steps[5].collect()))


def test_empty(spark, tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
