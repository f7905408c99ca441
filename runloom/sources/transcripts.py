"""Transcripts: JSONL files of agent sessions as a Spark data source (batch and stream) and their decoding into events.

Files are read in byte ranges of SPLIT bytes at most, small files many to a task;
a line belongs to the range in which its line feed lies. So neither a large file
nor a long backlog of a stream is read by one task, and the driver only lists
files and their sizes. A line counts once its line feed is there; what follows
the last one is left for later (rows with complete = false, in the batch source
only). Records are decoded in Python, as their text forms enter hashes and
previews, and become events natively. A record that cannot be decoded is
quarantined, never lost: it is malformed if it is no JSON object, else rejected.
"""

from __future__ import annotations

import functools
import glob
import itertools
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from runloom.functions.expressions import payload
from runloom.schema import EVENTS, SCHEMA_VERSION, schema_of
from runloom.sources.manifest import Manifest

#: part numbers a file's ranges, nth the lines of a range from 1.
RANGED = "path string, part int, nth long, byte_offset long, raw binary, complete boolean"
SPLIT = 8 << 20
#: Lines, and bytes of lines, that go to Spark and to decoding at once.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Ranges of large files whose line counts may be broadcast: under 200 bytes each.
BROADCAST_ROWS = 100_000
#: Record types that are plumbing.
META_TYPES = ("queue-operation", "last-prompt", "ai-title", "mode", "pr-link", "permission-mode", "file-history-snapshot", "system")
#: Lengths to which texts are cut before hashing.
CUT = {"isMeta": 500, "attachment": 2000, "meta": 1000, "block": 500}


def _open(path: str):
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def list_files(path: str | list[str]) -> list[tuple[str, int]]:
    """The files, with their sizes, that a path, folder or pattern (or each of a list) stands for, in order of name."""
    if isinstance(path, list):
        return sorted({x for p in path for x in list_files(p)})
    url = urlparse(path)
    hidden = lambda name: os.path.basename(name).startswith((".", "_"))
    if url.scheme in ("", "file"):
        found = glob.glob(os.path.join(url.path, "**"), recursive=True) if os.path.isdir(url.path) else glob.glob(url.path)
        return sorted((x, os.path.getsize(x)) for x in found if os.path.isfile(x) and not hidden(x))
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    info = store.get_file_info(name)
    found = store.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
    prefix = path.removesuffix(name)
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and not hidden(x.path))


class Piece(InputPartition):
    """Byte ranges (path, part, start, end) that one task reads; sizes of its files, where their ends matter."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges
        self.sizes: dict[str, int] = {}


def pieces(spans: list[tuple[str, int, int]], split: int = SPLIT) -> list[InputPartition]:
    """Spans (path, start, end) of files as tasks of about `split` bytes: long ones cut, short ones together."""
    out, held, size = [], [], 0
    for path, start, end in spans:
        for part, at in enumerate(range(start, end, split)):
            stop = min(end, at + split)
            if held and size + stop - at > split:
                out.append(Piece(held))
                held, size = [], 0
            held.append((path, part, at, stop))
            size += stop - at
    return [*out, Piece(held)] if held or not out else out


def _has_line_end(source, start: int, end: int, chunk: int = 1 << 16) -> bool:
    source.seek(start)
    return any(b"\n" in source.read(min(chunk, end - at)) for at in range(start, end, chunk))


def _line_start(source, at: int, chunk: int = 1 << 16) -> int:
    """Where the line that the byte at `at` belongs to begins."""
    while at > 0:
        first = max(0, at - chunk)
        source.seek(first)
        hit = source.read(at - first).rfind(b"\n")
        if hit >= 0:
            return first + hit + 1
        at = first
    return 0


def lines_of(path: str, start: int, end: int, with_rest: bool) -> Iterator[tuple[int, int, bytes, bool]]:
    """(nth, byte_offset, raw, complete) of the lines whose line feeds lie in [start, end); with_rest also gives what
    follows the last one, if anything does."""
    with _open(path) as source:
        if not with_rest and not _has_line_end(source, start, end):
            return  # all of it lies within one long line
        at = _line_start(source, start)
        source.seek(at)
        for nth in itertools.count(1):
            raw = source.readline() if at < end or with_rest else b""
            if not raw:
                return
            done = raw.endswith(b"\n")
            if at + len(raw) > end or not done:
                if with_rest and not done:
                    yield nth, at, raw, False
                return
            yield nth, at, raw[:-1], True
            at += len(raw)


class _BatchReader(DataSourceReader):
    """The ranges of all files; that with a file's end has the unfinished last line too."""

    def __init__(self, options: dict):
        found = json.loads(options["paths"]) if "paths" in options else options["path"]
        self.found, self.split = found, int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        """Only here are files listed: the reader itself goes to every task, and so has none of them."""
        files = dict(list_files(self.found))
        out = pieces([(path, 0, size) for path, size in files.items()], self.split)
        for piece in out:
            piece.sizes = {path: files[path] for path, *_ in piece.ranges}
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        for path, part, start, end in partition.ranges:
            for row in lines_of(path, start, end, end == partition.sizes[path]):
                yield path, part, *row


def _read_pieces(partition: Piece) -> Iterator[tuple]:
    for path, part, start, end in partition.ranges:
        for row in lines_of(path, start, end, False):
            yield path, part, *row


class _TailReader(DataSourceStreamReader):
    """Offsets are {path: bytes read}; appended bytes and new files are followed. A batch has the lines whose line feeds
    lie between two offsets, so a line that is still being written waits for a later one.

    Option maxBytes bounds what a batch has beyond the one before it, once one has been read: Spark does not tell this
    reader where a restarted query stands before it asks for the first end.
    """

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.first, self.most = json.loads(options.get("offsets", "{}")), int(options.get("maxBytes", 0))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        end = dict(list_files(self.path))
        if not self.most or self.at is None:
            return end
        left, out = self.most, {}
        for path, size in end.items():
            before = self.at.get(path, 0)
            out[path] = before + min(left, max(0, size - before))
            left -= out[path] - before
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {**(self.at or {}), **end}
        return pieces([(path, start.get(path, 0), stop) for path, stop in sorted(end.items()) if stop > start.get(path, 0)], self.split)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _read_pieces(partition)

    def commit(self, end: dict) -> None:
        pass


class _ManifestReader(DataSourceStreamReader):
    """As _TailReader, for many files: an offset is the number of a version in a manifest, whatever the number of files."""

    def __init__(self, options: dict):
        self.files, self.split = Manifest(options["manifest"], options["path"], int(options.get("maxBytes", 0))), int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": self.files.advance()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return pieces(self.files.between(start["version"], end["version"]), self.split)

    def read(self, partition: Piece) -> Iterator[tuple]:
        return _read_pieces(partition)

    def commit(self, end: dict) -> None:
        self.files.forget(end["version"])


def in_columns(rows: Iterator[tuple], most: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of RANGED as batches of at most so many rows, and of so many bytes unless a line alone has more."""
    schema, held, n = to_arrow_schema(schema_of(RANGED)), [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        if held and (len(held) == most or n + len(row[4]) > size):
            yield batch()
            held, n = [], 0
        held.append(row)
        n += len(row[4])
    if held:
        yield batch()


def _columnar(reader: type) -> type:
    """A reader whose rows go to Spark in columns, as turning them into such one by one takes longer than reading them."""

    class Columnar(reader):
        def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
            return in_columns(super().read(partition))

    return Columnar


class TranscriptSource(DataSource):
    """Format "transcript"; option path: a file, folder or pattern (or paths: a JSON list of them); split: bytes of a range;
    for streams, manifest: a folder of any file system that keeps what is read of each file (for many files), or offsets: where
    to begin (resume_offsets); maxBytes; and columns, for rows in columns."""

    @classmethod
    def name(cls) -> str:
        return "transcript"

    def schema(self) -> str:
        return RANGED

    def reader(self, schema) -> DataSourceReader:
        return _columnar(_BatchReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        reader = _ManifestReader if "manifest" in self.options else _TailReader
        return (_columnar(reader) if "columns" in self.options else reader)(self.options)


def read_lines(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """(path, line_no, byte_offset, raw, complete) of all lines; line numbers of files of several ranges follow from the
    lines that the ranges before have."""
    spark.dataSource.register(TranscriptSource)
    named = {"paths": json.dumps(path)} if isinstance(path, list) else {"path": path}
    rows = spark.read.format("transcript").options(**named, split=split).load()
    line = F.col("nth")
    large = {p: size for p, size in list_files(path) if size > split}
    if large:
        earlier = W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sizes = spark.read.format("transcript").options(paths=json.dumps(list(large)), split=split).load().groupBy("path", "part").agg(F.max("nth").alias("n"))
        ahead = sizes.select("path", "part", F.sum("n").over(earlier).alias("ahead"))
        ahead = F.broadcast(ahead) if sum(-(-size // split) for size in large.values()) <= BROADCAST_ROWS else ahead
        rows, line = rows.join(ahead, ["path", "part"], "left"), F.col("nth") + F.coalesce("ahead", F.lit(0))
    return rows.select("path", line.alias("line_no"), "byte_offset", "raw", "complete")


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """As read_lines; a stream does not know how many lines a file has before, so line_no is null."""
    spark.dataSource.register(TranscriptSource)
    rows = spark.readStream.format("transcript").options(path=path, columns="true", **options).load()
    return rows.select("path", F.lit(None).cast("long").alias("line_no"), "byte_offset", "raw", "complete")


# ---------------------------------------------------------------- decoding


def timestamp(value) -> datetime | None:
    """An ISO-8601 time; without a zone it is UTC; null if it is none."""
    try:
        found = datetime.fromisoformat(str(value).replace("Z", "+00:00")) if value else None
    except ValueError:
        return None
    return found if found is None or found.tzinfo else found.replace(tzinfo=UTC)


def _json(value, cut: int | None = None) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)[:cut]


def flatten(content) -> str:
    """The text of a message's content: a string, or a list of blocks joined by line feeds."""
    match content:
        case None:
            return ""
        case str():
            return content
        case list():
            return "\n".join(x for x in map(_flatten_block, content) if x)
        case _:
            return str(content)


def _flatten_block(block) -> str:
    match block:
        case {"type": "text"}:
            return block.get("text", "")
        case {"type": "tool_result"}:
            return flatten(block.get("content"))
        case dict():
            return _json(block, CUT["block"])
        case _:
            return str(block)


def _count(usage: dict, key: str) -> int:
    return usage.get(key) or 0


def _usage(message: dict) -> dict | None:
    usage = message.get("usage")
    if not isinstance(usage, dict):
        return None
    return {
        "model": message.get("model"), "input_tokens": _count(usage, "input_tokens"), "output_tokens": _count(usage, "output_tokens"),
        "cache_read_tokens": _count(usage, "cache_read_input_tokens"), "cache_creation_tokens": _count(usage, "cache_creation_input_tokens"),
    }


def _from_agent(record: dict) -> Iterator[dict]:
    """An event for each block; the first has the record's usage."""
    message = record.get("message") or {}
    blocks = message.get("content")
    blocks = ([""] if not blocks else blocks) if isinstance(blocks, list) else [flatten(blocks)]
    shared = {"source": "agent", "api_message_id": message.get("id") or record.get("requestId")}
    plain = "error" if record.get("isApiErrorMessage") and message.get("content") != [] else "message"
    for i, block in enumerate(blocks):
        usage = {"usage": _usage(message)} if i == 0 else {}
        match block:
            case {"type": "thinking"}:
                own = {"kind": "thinking", "text": block.get("thinking", "")}
            case {"type": "tool_use"}:
                own = {"kind": "tool_call", "text": json.dumps(block.get("input", {}), ensure_ascii=False), "tool_name": block.get("name"), "correlation_id": block.get("id")}
            case dict():
                own = {"kind": plain, "text": block["text"] if "text" in block else str(block)}
            case _:
                own = {"kind": plain, "text": str(block)}
        yield shared | own | usage


def _from_user(record: dict) -> Iterator[dict]:
    content = (record.get("message") or {}).get("content")
    if record.get("isMeta"):
        yield {"source": "meta", "kind": "session_meta", "text": flatten(content)[: CUT["isMeta"]], "tool_name": "isMeta"}
        return
    results = [x for x in content if isinstance(x, dict) and x.get("type") == "tool_result"] if isinstance(content, list) else []
    direct = record.get("toolUseResult")
    for x in results:
        yield {"source": "tool", "kind": "tool_result", "text": flatten(x.get("content")), "correlation_id": x.get("tool_use_id"), "is_error": bool(x.get("is_error"))}
    if not results and direct is not None:
        yield {"source": "tool", "kind": "tool_result", "text": direct if isinstance(direct, str) else json.dumps(direct, ensure_ascii=False), "correlation_id": record.get("sourceToolUseID")}
    elif not results:
        yield {"source": "user", "kind": "message", "text": flatten(content)}


def record_events(record: dict) -> Iterator[dict]:
    """The events of a record, without place and order. Unknown types are kept as such."""
    kind = record.get("type")
    if kind == "assistant":
        yield from _from_agent(record)
    elif kind == "user":
        yield from _from_user(record)
    elif kind == "attachment":
        yield {"source": "system", "kind": "attachment", "text": _json(record.get("attachment", {}), CUT["attachment"])}
    elif kind == "summary":
        yield {"source": "system", "kind": "compaction", "text": str(record.get("summary", ""))}
    elif kind in META_TYPES:
        yield {"source": "meta", "kind": "session_meta", "text": _json({k: v for k, v in record.items() if k != "type"}, CUT["meta"]), "tool_name": kind}
    else:
        yield {"source": "meta", "kind": "unknown", "text": _json(record, CUT["meta"]), "tool_name": str(kind)}


DECODED = (
    "path string, line_no long, byte_offset long, block_index int, outcome string, record_id string, ts timestamp, source string, kind string, session_id string, "
    "agent_id string, parent_event_id string, correlation_id string, api_message_id string, text string, tool_name string, is_error boolean, "
    "usage struct<model:string,input_tokens:long,output_tokens:long,cache_read_tokens:long,cache_creation_tokens:long>"
)


def _line_rows(path: str, line_no: int | None, offset: int, raw: bytes) -> list[dict]:
    """Rows of DECODED for a complete line, whose values may still be of wrong types."""
    place = {"path": path, "line_no": line_no, "byte_offset": offset, "block_index": 0}
    if not raw.strip():
        return [place | {"outcome": "blank"}]
    try:
        record = json.loads(raw)
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return [place | {"outcome": "malformed"}]
    try:
        stem = "" if record.get("uuid") else os.path.splitext(os.path.basename(path))[0]
        common = {
            "outcome": "event", "record_id": record.get("uuid") or (f"{stem}:{line_no}" if line_no is not None else f"{stem}@{offset}"), "ts": timestamp(record.get("timestamp")),
            "session_id": record.get("sessionId", "unknown"), "agent_id": "sidechain" if record.get("isSidechain") else None, "parent_event_id": record.get("parentUuid"),
        }
        return [place | common | e | {"block_index": i} for i, e in enumerate(record_events(record))]
    except (AttributeError, TypeError, ValueError):
        return [_rejected(path, line_no, offset)]


def _rejected(path: str, line_no: int | None, offset: int) -> dict:
    return {"path": path, "line_no": line_no, "byte_offset": offset, "block_index": 0, "outcome": "rejected"}


def _in_columns(lines: list[list[dict]]) -> Iterator[pa.RecordBatch]:
    """The rows of lines in batches, in order. A line that has a value of a wrong type is rejected; it is found by halving."""
    try:
        yield pa.RecordBatch.from_pylist([row for rows in lines for row in rows], schema=_decoded_schema())
    except (AttributeError, TypeError, ValueError, pa.ArrowException):
        if len(lines) > 1:
            yield from _in_columns(lines[: len(lines) // 2])
            yield from _in_columns(lines[len(lines) // 2 :])
        else:
            first = lines[0][0]
            yield from _in_columns([[_rejected(first["path"], first["line_no"], first["byte_offset"])]])


def decode_line(path: str, line_no: int | None, offset: int, raw: bytes) -> list[dict]:
    """Rows of DECODED for a complete line; one row without a kind tells of a blank, malformed or rejected line.

    A record without an id is named after its file and line, or its place in bytes where the line is not known.
    """
    return [row for batch in _in_columns([_line_rows(path, line_no, offset, raw)]) for row in batch.to_pylist()]


@functools.cache
def _decoded_schema() -> pa.Schema:
    return to_arrow_schema(schema_of(DECODED))


def decode(lines: DataFrame) -> DataFrame:
    """Rows of DECODED for each complete line."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("path", "line_no", "byte_offset", "raw")]
            yield from _in_columns([_line_rows(*line) for line in zip(*columns)])

    return lines.where("complete").drop("complete").mapInArrow(each, DECODED)


def to_events(decoded: DataFrame, with_seq: bool = True) -> DataFrame:
    """Canonical events; seq counts the events of a path in order of line and block (left null in streams, where the state counts)."""
    rows = decoded.where("outcome = 'event'")
    order = W.partitionBy("path").orderBy("line_no", "block_index")
    seq = (F.row_number().over(order) - 1).cast("long") if with_seq else F.lit(None).cast("long")
    cols = {
        "seq": seq, "event_id": F.concat_ws("#", "record_id", "block_index"), "payload": payload(F.col("text"), F.col("tool_name"), F.coalesce("is_error", F.lit(False))),
        "raw": F.struct("path", "line_no", "byte_offset", "block_index"), "schema_version": F.lit(SCHEMA_VERSION),
    }
    return rows.withColumns(cols).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return to_events(decode(read_lines(spark, path)))


def parse_stats(lines: DataFrame, decoded: DataFrame) -> DataFrame:
    """Lines, events, malformed and rejected lines and bytes of an unfinished last line, by path."""
    of_lines = lines.groupBy("path").agg(F.count_if("complete").alias("lines"), F.coalesce(F.sum(F.when(~F.col("complete"), F.octet_length("raw"))), F.lit(0)).cast("long").alias("trailing_partial_bytes"))
    of_rows = decoded.groupBy("path").agg(*[F.count_if(F.col("outcome") == x).alias(n) for x, n in (("event", "events"), ("malformed", "malformed"), ("rejected", "rejected"))])
    return of_lines.join(of_rows, "path", "left").na.fill(0)


def unknown_types(decoded: DataFrame) -> DataFrame:
    return decoded.where("kind = 'unknown'").groupBy("path", F.col("tool_name").alias("type")).agg(F.count("*").alias("n"))


def list_sessions(spark: SparkSession, path: str, most: int | None = 15) -> DataFrame:
    """The latest session files under a folder, those of subagents and those of no bytes left out; without `most` all, in no order.

    Spark deals some 30 small files to a partition; here a task has many such partitions, as looking at a file takes less than a task does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    found = files.select("path", "modificationTime", "length").where(~F.contains("path", F.lit("subagents"))).coalesce(4 * spark.sparkContext.defaultParallelism)
    return found if most is None else found.orderBy(F.desc("modificationTime"), "path").limit(most)


def marks(lines: DataFrame, decoded: DataFrame) -> DataFrame:
    """How far each path is read: (path, observed_seq, durable_offset, source_line, malformed, unknown_types)."""
    done = lines.where("complete").groupBy("path").agg((F.max(F.col("byte_offset") + F.octet_length("raw")) + 1).alias("durable_offset"), F.max("line_no").alias("source_line"))
    seen = decoded.groupBy("path").agg((F.count_if(F.col("outcome") == "event") - 1).alias("observed_seq"), F.count_if(F.col("outcome") == "malformed").alias("malformed"))
    types = unknown_types(decoded).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("unknown_types"))
    out = done.join(seen, "path", "left").join(types, "path", "left")
    return out.select("path", "observed_seq", "durable_offset", "source_line", "malformed", "unknown_types")


def resume_offsets(mark_rows: DataFrame) -> str:
    """Option `offsets` of the stream that goes on where marks end (one number for each file, as Spark's own offsets have)."""
    return json.dumps({r["path"]: r["durable_offset"] for r in mark_rows.select("path", "durable_offset").collect()})


def write_snapshot(events: DataFrame, path: str, mark_rows: DataFrame | None = None) -> None:
    """The events as a table, in one folder for each kind, so that readers of a kind skip the others; the marks beside it."""
    events.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/events")
    if mark_rows is not None:
        mark_rows.write.mode("overwrite").parquet(f"{path}/marks")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{path}/events").select(*EVENTS.names)
