"""A recount of transcripts from their raw JSON, apart from decoding, events and fold, to check these against.

Each line is parsed to a variant by Spark; what is counted follows from its
fields. Nothing is shared with the other way but the fixed lists of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.expressions import FILE_TOOLS

#: What is recounted of each path.
FIELDS = ("n_turns", "n_tool_calls", "n_tool_errors", "input_tokens", "output_tokens", "cache_read_tokens", "tools", "files", "pending")

#: Names of tokens in a record's usage, and here.
TOKENS = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_input_tokens": "cache_read_tokens"}


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _joined(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names)), "\n")


def _records(lines: DataFrame) -> DataFrame:
    raw = F.col("raw").cast("string")
    v = F.try_parse_json(raw)
    # Whether a line could be parsed is no filter, which would be pushed before this and parse each line twice: `parsed` tells.
    rows = lines.where("complete").where(raw.rlike(r"^[ \t\r]*\{")).select("path", "line_no", v.alias("v"))
    truthy = lambda p: F.coalesce(F.try_variant_get("v", p, "boolean"), F.lit(False))
    return rows.select(
        "path", "line_no", "v", F.col("v").isNotNull().alias("parsed"), _text(F.col("v"), "$.type").alias("type"), truthy("$.isSidechain").alias("side"), truthy("$.isMeta").alias("meta"),
        F.try_variant_get("v", "$.message.content", "array<variant>").alias("blocks"),
    )


def _blocks(records: DataFrame) -> DataFrame:
    """A row for each block of a record, and one at least, with what the record says itself: asks and, if it has usage, its key and tokens."""
    v, blocks = F.col("v"), F.coalesce("blocks", F.array().cast("array<variant>"))
    direct = F.try_variant_get(v, "$.toolUseResult", "variant")
    said = F.when(F.col("blocks").isNull(), _text(v, "$.message.content")).otherwise(
        F.array_join(F.transform(F.filter("blocks", lambda b: _text(b, "$.type") == "text"), lambda b: _text(b, "$.text")), "\n")
    )
    bare = F.regexp_replace(F.coalesce(said, F.lit("")), r"^[\s\u0085\u001c-\u001f]+", "")
    results = F.exists(blocks, lambda b: _text(b, "$.type") == "tool_result")
    asks = (F.col("type") == "user") & ~F.col("side") & ~F.col("meta") & ~results & (direct.isNull() | F.is_variant_null(direct))
    asks = asks & (bare != "") & ~bare.startswith("<") & ~bare.startswith("[Request interrupted by user")
    api = F.coalesce(F.nullif(_text(v, "$.message.id"), F.lit("")), F.nullif(_text(v, "$.requestId"), F.lit("")), _text(v, "$.uuid"))
    usage = F.when(F.col("type") == "assistant", F.try_variant_get(v, "$.message.usage", "map<string,variant>"))
    counted = {n: F.try_variant_get(v, f"$.message.usage.{f}", "long").alias(n) for f, n in TOKENS.items()}
    told = records.select("path", "line_no", "parsed", "type", "side", "meta", blocks.alias("blocks"), F.coalesce(asks.cast("long"), F.lit(0)).alias("asks"), api.alias("api"), usage.isNotNull().alias("spends"), *counted.values())
    return told.select("*", F.posexplode_outer("blocks").alias("nth", "b")).drop("blocks")


def _items(records: DataFrame) -> DataFrame:
    """(path, item, key, n, open, line_no, place, tokens): all that is counted, by one row a record, one more for its usage, and
    one to three for each call or result block of the main thread. So lines are read and parsed once; all else is two groupings."""
    rows, b, main = _blocks(records), F.col("b"), ~F.col("side") & ~F.col("meta")
    kind = _text(b, "$.type")
    call, result = main & (F.col("type") == "assistant") & (kind == "tool_use"), main & (F.col("type") == "user") & (kind == "tool_result")
    rows = rows.withColumns({"call": F.coalesce(call, F.lit(False)), "result": F.coalesce(result, F.lit(False))})
    file = F.coalesce(*[F.nullif(_text(b, f"$.input.{k}"), F.lit("")) for k in ("file_path", "notebook_path", "path")])
    rows = rows.withColumns({
        "name": F.when(F.col("call"), F.coalesce(_text(b, "$.name"), F.lit("unknown-tool"))),
        "id": F.when(F.col("call"), _text(b, "$.id")).when(F.col("result"), _text(b, "$.tool_use_id")),
        "failed": F.col("result") & F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False)),
    })
    rows = rows.withColumn("file", F.when(F.col("name").isin(*FILE_TOOLS), file)).drop("b")
    first, item = F.col("parsed") & (F.coalesce("nth", F.lit(0)) == 0), lambda what, key, n: F.struct(F.lit(what).alias("item"), key.alias("key"), n.cast("long").alias("n"))
    none, one = F.lit(None).cast("string"), F.lit(1)
    found = F.array_compact(F.array(
        F.when(first, item("record", none, F.col("asks"))), F.when(first & F.col("spends"), item("usage", F.col("api"), one)),
        F.when(F.col("call"), item("tool", F.col("name"), one)), F.when(F.col("id") != "", item("id", F.col("id"), one)),
        F.when(F.col("file").isNotNull(), item("file", F.col("file"), one)), F.when(F.col("failed"), item("failed", none, one)),
    ))
    # One number for line and block: groupings by hash need values of a fixed width.
    place = F.col("line_no").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.coalesce("nth", F.lit(0))
    return rows.select("path", "line_no", place.alias("place"), F.col("call").alias("open"), *TOKENS.values(), F.explode(found).alias("x")).select("*", "x.*").drop("x")


def recount(lines: DataFrame) -> DataFrame:
    """(path, FIELDS) of the transcripts whose lines(path, line_no, raw, complete) are given."""
    tokens = list(TOKENS.values())
    # An id is pending if the last that is seen of it is a call; the first record of a message pays.
    keys = _items(_records(lines)).groupBy("path", "item", "key").agg(
        F.sum("n").alias("n"), F.max_by("open", "place").alias("open"), *[F.min_by(c, "line_no").alias(c) for c in tokens]
    )
    of = lambda what: F.col("item") == what
    many = lambda what: F.coalesce(F.sum(F.when(of(what), F.col("n"))), F.lit(0))
    names = lambda which, said="key": _joined(F.collect_list(F.when(which, F.col(said) if isinstance(said, str) else said)))
    paid = [F.coalesce(F.sum(F.when(of("usage"), F.col(c))), F.lit(0)).alias(c) for c in tokens]
    out = keys.groupBy("path").agg(
        many("record").alias("n_turns"), many("tool").alias("n_tool_calls"), many("failed").alias("n_tool_errors"), *paid,
        names(of("tool"), F.concat_ws("=", "key", F.col("n").cast("string"))).alias("tools"), names(of("file")).alias("files"), names(of("id") & F.col("open")).alias("pending"),
    )
    return out.select("path", *FIELDS)


def told(state: DataFrame) -> DataFrame:
    """What the fold's states say of FIELDS, in the form of recount."""
    return state.select(
        "path", "n_turns", "n_tool_calls", "n_tool_errors",
        F.col("tokens")[0].alias("input_tokens"), F.col("tokens")[1].alias("output_tokens"), F.col("tokens")[2].alias("cache_read_tokens"),
        _joined(F.transform("tools", lambda t: F.concat_ws("=", t["name"], t["n"].cast("string")))).alias("tools"),
        _joined(F.transform("files", lambda f: f["name"])).alias("files"),
        _joined(F.transform("pending", lambda p: p["correlation_id"])).alias("pending"),
    )
