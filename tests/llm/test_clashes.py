"""Further columns of clashing names, in every operator that gives rows of its input back and in every stage."""

import corpus_pipeline as P
from runloom.llm import mixing

NAMES = ["_id", "gone_id", "_GONE_ID", "_copies", "_nth", "mix_id", "mix_copies", "MIX_NTH", "a.b", "kept", "keep_id", "component_id", "fp", "src", "size", "bucket", "units", "root", "h", "k", "ids"]


def test_stages_carry_columns_of_any_name(spark):
    text = "ka lo mi tu " * 20
    rows = [(i, f"{text} {i} {'lo ka ' * i}", "aa", f"s{i % 2}", 5, *["x"] * len(NAMES)) for i in range(30)] + [(40, f"{text} 3 lo ka lo ka lo ka ", "aa", "s1", 5, *["x"] * len(NAMES))]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *NAMES])
    docs = df
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert docs.columns == df.columns, name
        assert docs.count() > 0 and {r["mix_id"] for r in docs.collect()} == {"x"}, name
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_mixed_rows_are_repeated_as_often_as_they_are_copied(corpus):
    rows, df = corpus
    most: dict = {}
    for r in mixing.mix(df).collect():
        most[r["doc_id"]] = max(most.get(r["doc_id"], 0), r["copies"])
    got = sorted(map(str, mixing.mixed_rows(df).collect()))
    assert got == sorted(str(r) for r in df.collect() for _ in range(most[r["doc_id"]]))
