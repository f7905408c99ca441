"""Chat formatting with Spark expressions only.

Turn structs of a conversation are collected and sorted, adjacent turns of one
role are merged into a block by array functions over the places where the role
changes (each turn is copied once), and the blocks are concatenated. Where a
text will stand is a running sum over the conversation's rows, taken before
they are collected in the same partitioning. The template:

    <turn:ROLE>text<next>text</turn>\\n

Every text and role is escaped before it enters the template, so control
strings inside texts stay apart from those of the template and come back
unchanged: ``\\`` becomes ``\\-`` and ``<`` becomes ``\\l`` (in roles also
``>`` becomes ``\\g``), after which no text holds ``<``. The loss mask lists
the (start, length) code-point spans of assistant texts in the output.

Defined cases: a null text or role counts as empty; null turns sort first;
turns that tie are ordered by role, then text (as they are, before escaping), and
repeated rows are repeated turns; rows with a null conversation id form one
conversation; texts of any length and conversations of any number of turns are
formatted whole, each as one value (2 GB at most, as any in Spark); an empty
table gives an empty result. Only the four named columns are read, so others
cannot clash. The query's control case is conversation -7; rows of the table with
that id are further turns of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.common import table

OPEN, NAME_END, NEXT, CLOSE = "<turn:", ">", "<next>", "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\-")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\-"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def _merged(turns: Column) -> Column:
    """The blocks, slices of turns that share a role, in order: each from a turn of a new role up to the next such turn."""
    n = F.size(turns)
    heads = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(turns, i)["new"])
    return F.zip_with(heads, F.concat(F.slice(heads, 2, n), F.array(n + 1)), lambda a, b: F.slice(turns, a, b - a))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, chars>>); start counts code points from 1."""
    rows = rows.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    rows = rows.withColumn("first", before.isNull()).withColumn("new", ~before.eqNullSafe(F.col("role"))).withColumn("chars", F.length(escape(F.col("text"))).cast("long"))
    head = F.when(F.col("first"), 0).otherwise(len(CLOSE)) + len(OPEN) + F.length(escape_role(F.col("role"))) + len(NAME_END)
    ahead = F.when(F.col("new"), head).otherwise(len(NEXT))
    rows = rows.withColumn("start", F.sum(ahead + F.col("chars")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("chars") + 1)
    turn = F.struct("turn", "role", "text", "start", "chars", "new")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    body = lambda block: F.array_join(F.transform(block, lambda t: escape(t["text"])), NEXT)
    pieces = F.transform(_merged(F.col("turns")), lambda b: F.concat(F.lit(OPEN), escape_role(b[0]["role"]), F.lit(NAME_END), body(b), F.lit(CLOSE)))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars")))
    return grouped.select("conv_id", F.array_join(pieces, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns array<struct<role, text>> that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, F.lit(CLOSE)), lambda b: b != "")

    def turns(block: Column) -> Column:
        end = F.instr(block, NAME_END)
        role = unescape_role(F.substring(block, F.lit(len(OPEN) + 1), end - len(OPEN) - 1))
        body = F.substring(block, end + 1, F.length(block))
        return F.transform(F.split(body, F.lit(NEXT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["chars"].cast("int")))), "")


def control_case(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = format_conversations(rows.unionByName(control_case(spark)))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(text, '\', '\-'), '<', '\l') AS t,
         replace(replace(replace(role, '\', '\-'), '<', '\l'), '>', '\g') AS r FROM rows),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM escaped)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t) + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 15 + length(r) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
