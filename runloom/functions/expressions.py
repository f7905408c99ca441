"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.schema import INLINE_CAP

#: Dollars for a million tokens, by the first key that a model's name contains; the last is for all others.
PRICES = {
    "test-premium": {"input": "15.0", "output": "75.0", "cache_read": "1.5", "cache_write": "18.75"},
    "claude-opus": {"input": "15.0", "output": "75.0", "cache_read": "1.5", "cache_write": "18.75"},
    "claude-sonnet": {"input": "3.0", "output": "15.0", "cache_read": "0.3", "cache_write": "3.75"},
    "claude-haiku": {"input": "0.8", "output": "4.0", "cache_read": "0.08", "cache_write": "1.0"},
    "_default": {"input": "3.0", "output": "15.0", "cache_read": "0.3", "cache_write": "3.75"},
}
#: Starts of user records that are actions and no requests.
NOT_A_TURN = ("<", "[Request interrupted by user")
#: Tools whose input names a file.
FILE_TOOLS = ("Read", "Write", "Edit", "NotebookEdit", "read_file", "write_file")
#: A line `key = value`.
FACT_LINE = r"(?U)^\s*([A-Za-z_][\w.\-]{1,40})\s*=\s*(.{1,120}?)\s*$"
PATH_ARGUMENT = r'"(?:file_path|notebook_path|path)"\s*:\s*"([^"]+)"'

#: White space as the scripting language of transcripts sees it, wider than SQL's trim.
SPACE = r"[\s\u001c-\u001f\u0085   -     　]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def text() -> Column:
    return F.coalesce(F.col("payload.text"), F.lit(""))


def whole_text(events: DataFrame) -> Column:
    """The whole text where events carry it beside the payload, else what the payload has."""
    return F.coalesce(F.col("whole_text"), F.lit("")) if "whole_text" in events.columns else text()


def main_thread() -> Column:
    return F.col("agent_id").isNull()


def is_turn() -> Column:
    """A user message of the main thread that asks for something."""
    said = strip(text())
    other = [said.startswith(x) for x in NOT_A_TURN]
    asks = (said != "") & ~other[0] & ~other[1]
    return main_thread() & (F.col("kind") == "message") & (F.col("source") == "user") & (F.coalesce(F.col("raw.block_index"), F.lit(0)) == 0) & asks


def tool(missing: str = "unknown-tool") -> Column:
    return F.coalesce(F.nullif(F.col("payload.tool_name"), F.lit("")), F.lit(missing))


def is_call() -> Column:
    return main_thread() & (F.col("kind") == "tool_call")


def is_result() -> Column:
    return main_thread() & (F.col("kind") == "tool_result")


def failed() -> Column:
    return F.coalesce(F.col("payload.is_error"), F.lit(False))


def price(model: Column, what: str) -> Column:
    """Micro-dollars for a token, as an exact decimal."""
    keys = [k for k in PRICES if k != "_default"]
    of = lambda k: F.lit(PRICES[k][what]).cast("decimal(8,4)")
    out = of("_default")
    for k in reversed(keys):
        out = F.when(F.coalesce(model.contains(k), F.lit(False)), of(k)).otherwise(out)
    return out


def cost_micros() -> Column:
    """Micro-dollars of the usage of a row."""
    parts = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_tokens", "cache_write": "cache_creation_tokens"}
    terms = [F.coalesce(F.col(f"usage.{c}"), F.lit(0)).cast("decimal(18,0)") * price(F.col("usage.model"), k) for k, c in parts.items()]
    return sum(terms[1:], terms[0]).cast("decimal(38,4)")


def dollars(micros: Column) -> Column:
    return micros.cast("double") / 1_000_000


def base_key(key: Column) -> Column:
    """A fact's key without its source before the last colon and without its version."""
    return F.substring_index(F.substring_index(key, ":", -1), "#", 1)


def whole_number(value: Column) -> Column:
    """An ASCII whole number of up to 38 digits, else null (other digits and underscores are no numbers here)."""
    bare = strip(value)
    return F.when(bare.rlike(r"^[+-]?[0-9]{1,38}$"), bare.try_cast("decimal(38,0)"))


def normalised_answer(value: Column) -> Column:
    return F.lower(strip(F.regexp_replace(value, f"{SPACE}+", " ")))


def payload(body: Column, tool_name: Column | None = None, is_error: Column | None = None) -> Column:
    """The payload struct of a text: capped, with the hash and length of the whole."""
    whole = F.coalesce(body, F.lit(""))
    return F.struct(
        F.substring(whole, 1, INLINE_CAP).alias("text"),
        (F.length(whole) > INLINE_CAP).alias("truncated"),
        F.sha2(whole, 256).alias("sha256"),
        F.length(whole).cast("long").alias("char_len"),
        (F.lit(None).cast("string") if tool_name is None else tool_name).alias("tool_name"),
        F.lit(None).cast("string").alias("tool_input_preview"),
        (F.lit(False) if is_error is None else is_error).alias("is_error"),
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def file_path() -> Column:
    """The file that a call of a file tool names: its JSON field, or the first such pair in a cut or odd input."""
    named = F.coalesce(*[F.nullif(F.get_json_object(F.col("payload.text"), f"$.{k}"), F.lit("")) for k in ("file_path", "notebook_path")])
    found = F.nullif(F.regexp_extract(text(), PATH_ARGUMENT, 1), F.lit(""))
    whole = F.when(F.coalesce(F.col("payload.truncated"), F.lit(False)), F.lit(None).cast("string")).otherwise(named)
    return F.when(is_call() & F.col("payload.tool_name").isin(*FILE_TOOLS), F.coalesce(whole, found))
