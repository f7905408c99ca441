"""The canonical events schema. One path is one session; seq orders it."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
#: Longest text that an event carries; the hash and the length are those of the whole text.
INLINE_CAP = 4000

#: Fixed values.
KINDS = ("message", "thinking", "tool_call", "tool_result", "attachment", "compaction", "error", "session_meta", "unknown")
SOURCES = ("user", "agent", "tool", "system", "meta")

PAYLOAD = "text string, truncated boolean, sha256 string, char_len long, tool_name string, tool_input_preview string, is_error boolean"
USAGE = "model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"
RAW = "path string, line_no long, byte_offset long, block_index int"


ATOMS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def _parts(text: str) -> list[str]:
    """text cut at commas outside angle brackets."""
    out, depth, held = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held)
            held = ""
        else:
            held += c
    return [x.strip() for x in [*out, held] if x.strip()]


def _type(text: str) -> T.DataType:
    head, _, inner = text.partition("<")
    if head == "array":
        return T.ArrayType(_type(inner[:-1].strip()))
    if head == "struct":
        return T.StructType([T.StructField(n.strip(), _type(t.strip())) for n, _, t in (x.partition(":") for x in _parts(inner[:-1]))])
    return ATOMS[head]


def schema_of(ddl: str) -> T.StructType:
    """The schema of a DDL string, without a session (workers read it too)."""
    return T.StructType([T.StructField(n, _type(t.strip())) for n, _, t in (x.partition(" ") for x in _parts(ddl))])


def _struct(ddl: str) -> str:
    return "struct<" + ddl.replace(" ", ":").replace(",:", ",") + ">"


EVENTS_DDL = (
    "path string, seq long, event_id string, record_id string, ts timestamp, source string, kind string, session_id string, agent_id string, "
    "parent_event_id string, correlation_id string, api_message_id string, "
    f"payload {_struct(PAYLOAD)}, usage {_struct(USAGE)}, raw {_struct(RAW)}, schema_version int"
)
EVENTS: T.StructType = schema_of(EVENTS_DDL)
