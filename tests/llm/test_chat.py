import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    done = chat.format_conversations(df)
    return {r["conv_id"]: r for r in done.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_template_and_merging(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", "q"), (1, 1, "assistant", "a")]
    got = formatted(spark, rows)[1]
    assert got["formatted"] == "<turn:user>q</turn>\n<turn:assistant>a<next>b</turn>\n"
    assert [(t["role"], t["text"]) for t in got["turns"]] == [("user", "q"), ("assistant", "a"), ("assistant", "b")]
    assert got["loss"] == "ab"


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, None, "assistant", "n"), (2, 5, "system", "")]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("user", "x"), ("user", "x")]
    assert got[None]["loss"] == "n" and got[2]["loss"] == ""
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("system", "")]


def test_ties_are_ordered_by_the_texts_themselves(spark):
    """`<` is escaped to a character beyond `=`; the order is that of the texts as they are."""
    got = formatted(spark, [(1, 0, "user", "= y"), (1, 0, "user", "< x"), (1, 0, "us<", "z"), (1, 0, "us=", "z")])
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("us<", "z"), ("us=", "z"), ("user", "< x"), ("user", "= y")]


def test_many_turns_and_a_long_text(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"<{i}>\\") for i in range(20_000)] + [(2, 0, "assistant", "<😀\\ word" * 300_000)]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, x) for _, _, r, x in rows[:-1]]
    assert got[1]["loss"] == "".join(x for _, _, r, x in rows[:-1] if r == "assistant") and got[2]["loss"] == rows[-1][3]


def test_spans_are_places_in_the_output(spark):
    rows = [(1, 0, "assistant", "😀<a"), (1, 1, "assistant", ""), (1, 2, "us>er", "q"), (1, 3, "assistant", "end")]
    r = formatted(spark, rows)[1]
    assert [r["formatted"][s["start"] - 1 :][: s["chars"]] for s in r["loss_spans"]] == ["😀\\la", "", "end"]


def test_one_shuffle(spark):
    plan = chat.format_conversations(spark.createDataFrame([(1, 2, "a", "b", "c")], SCHEMA))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rows_of_the_control_conversation_join_it(spark, tmp_path):
    spark.createDataFrame([(-7, 5, "user", "more")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = chat.op1_chat_format(spark, str(tmp_path))
    assert [(r["conv_id"], r["n_turns"]) for r in out.collect()] == [(-7, 3)]
    assert out.dtypes[:6] == [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")]


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


HARD = st.text(alphabet="\\<>lg-/tunrex:# \nasi😀é", max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn:user>", "a>b\\"]), HARD), min_size=1, max_size=5), min_size=1, max_size=8))
def test_round_trip(spark, talks):
    got = formatted(spark, [(c, t, role, text) for c, turns in enumerate(talks) for t, (role, text) in enumerate(turns)])
    for c, turns in enumerate(talks):
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")


def test_query_digests(spark, tmp_path):
    rows = [(3, 1, "assistant", "hé<"), (3, 0, "user", None), (4, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    assert got[3]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nhé<\n".encode()).hexdigest()
    assert (got[3]["loss_chars"], got[3]["loss_sha256"]) == (3, hashlib.sha256("hé<".encode()).hexdigest())
    text = "\\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[4]["loss_sha256"] == hashlib.sha256(b"").hexdigest() and got[4]["n_turns"] == 1


def test_no_python(spark):
    plan = chat.format_conversations(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["\\l", "\\-l", "\\\\", "<\\l>", "\\g"])
def test_escape(spark, text):
    row = spark.range(1).select(chat.unescape(chat.escape(F.lit(text))).alias("a"), chat.unescape_role(chat.escape_role(F.lit(text))).alias("b")).first()
    assert row["a"] == text and row["b"] == text
