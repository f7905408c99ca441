"""WARC archives: writing through Spark's text sink, reading by boundary-chain verification.

A record ends with two line breaks, which serve as the separator of the text
sink; so archives are written by Spark's own committer to any file system. A
payload of at least ``least`` bytes that repeats is written once, as a response,
and its other pages are revisits of that record. Payloads whose digests repeat
are compared by their bytes.

To read, archives are cut into byte ranges. A task looks for every version
line in its range and emits the offset of the candidate record with that of
its successor (header end + Content-Length + separator), already followed to
the first offset outside the range. Pointer jumping from offset 0 then keeps
the offsets that are reached; magic inside a payload is never reached, as no
chain from the start lands on it. At last each range is walked from the offset
by which the chain enters it. A header may have any length: of a candidate's
that is longer than ``HEADER_MAX`` only the end and the length line are looked
for, by chunks and once for all candidates before that end. A chain that leads
to no record ends there, or raises an error if ``strict``.

Defined cases: a null payload is empty; a null id or URI has no value in its
header and reads back as null; a URI that a header line cannot hold stands there
with %20 for what it cannot, and as it is in a line of its own; equal rows are
records of their own; a payload of any length is one record, hashed by chunks
when read; a table without rows gives an archive without records. Only the three
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote_plus, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import bounded_broadcast, scratch_path, table, written

BREAK = "\r\n"
END = BREAK * 2
MAGIC = b"WARC/1."
LENGTH = re.compile(rb"\r\n[ \t]*content-length[ \t]*:([^\r\n]{0,40})(?=\r\n)", re.IGNORECASE)
HTTP = f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{END}"
URN = "urn:runloom:page:"
SPLIT = 8 << 20
CHUNK = 1 << 20
#: Tasks over which the ranges are dealt at most.
MOST_TASKS = 20_000
#: Longest header that is held for a candidate; those on the chain are held whole.
HEADER_MAX = 1 << 20
#: Rows (digest, id) that may be broadcast: under 100 bytes each, 20 MB in all.
BROADCAST_ROWS = 200_000


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> None:
    """Write one record per row of pages into WARC files under path."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("strong", F.when(F.col("bytes") >= least, F.sha2(F.col("payload").cast("binary"), 256)))
    named = rows.where("strong is not null").groupBy("strong").agg(F.count("*").alias("n")).where("n > 1").select("strong")
    suspects = rows.join(bounded_broadcast(written(named, "payloads"), BROADCAST_ROWS), "strong", "left_semi")
    # Grouping by the payload itself is the comparison: only equal bytes share a row.
    groups = written(suspects.groupBy("strong", "payload").agg(F.max("page_id").alias("first_id")).select("strong", "first_id"), "groups")
    if groups.count() != groups.select("strong").distinct().count():
        raise RuntimeError("two different payloads have one SHA-256 digest")
    rows = rows.join(bounded_broadcast(groups, BROADCAST_ROWS), "strong", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))

    ident = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")  # the others of Unicode's spaces stay
    length = F.when(revisit, F.lit(len(HTTP))).otherwise(F.col("bytes") + len(HTTP))
    record = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        line("WARC-Date", F.lit("2020-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", safe_url), F.lit("")),
        F.when(F.col("url") != safe_url, line("X-Target-URI-Encoded", F.url_encode("url"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", ident(F.col("first_id"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(BREAK + HTTP),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _open(path: str):
    """A seekable reader of an archive; executors share the folder or reach the store through pyarrow."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Header:
    """Fields of the record header at an offset: names in lower case, the offset of its block and of its successor."""

    def __init__(self, at: int, data: bytes, size: int):
        lines = data.split(BREAK.encode())
        self.at = at
        self.fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:]) if k}
        self.block = at + len(data) + len(END)
        self.length = int(self.fields["content-length"])
        self.next = self.block + self.length + len(END)
        if self.length < 0 or self.next > size:
            raise ValueError("the block reaches beyond the file")


def _header_bytes(source, at: int, size: int, most: int | None = None) -> bytes | None:
    """What stands from an offset up to the first blank line, or None if there is none (within about `most` bytes)."""
    source.seek(at)
    data, end = source.read(4096), -1
    while (end := data.find(END.encode())) < 0 and len(data) < min(most or size, size - at) and data.startswith(MAGIC):
        more = source.read(len(data))
        if not more:
            break
        data += more
    return None if end < 0 else data[:end]


def _header(source, at: int, size: int, data: bytes | None = None) -> Header | None:
    """The header at an offset, of any length, or None if no valid one is there."""
    data = _header_bytes(source, at, size) if data is None else data
    if data is None or not data.startswith(MAGIC):
        return None
    try:
        return Header(at, data, size)
    except (KeyError, ValueError):
        return None


def _far_end(source, at: int, size: int) -> tuple[int, int, bytes]:
    """(the first blank line from an offset on or the file's end, the last length line before it or -1, its value), by chunks."""
    source.seek(at)
    pos, carry, line, value = at, b"", -1, b""
    while pos < size and (data := source.read(CHUNK)):
        start, data = pos - len(carry), carry + data
        end = data.find(END.encode())
        for hit in LENGTH.finditer(data, 0, end + len(BREAK) if end >= 0 else len(data)):
            line, value = start + hit.start(), hit[1]
        if end >= 0:
            return start + end, line, value
        pos, carry = start + len(data), data[-256:]
    return size, line, value


def _successors(source, hits: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(offset, successor) of the hits, in order, that are headers of any length."""
    stop, line, value = -1, -1, b""
    for at in hits:
        if at >= stop:
            data = _header_bytes(source, at, size, HEADER_MAX)
            if data is not None:
                if head := _header(source, at, size, data):
                    yield at, head.next
                if len(data) > 4096:
                    stop, line, value = _far_end(source, at, size)
                continue
            stop, line, value = _far_end(source, at, size)
        try:
            length = int(value) if line >= at else -1
        except ValueError:
            length = -1
        beyond = stop + len(END) + length + len(END)
        if length >= 0 and stop < size and beyond <= size:
            yield at, beyond


def _candidates(source, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor followed out of the range) of each candidate whose version line begins in [start, end)."""
    hits: list[int] = []
    at, tail = start, b""
    while at < end:
        source.seek(at)
        data = tail + source.read(min(CHUNK, end - at))
        base = at - len(tail)
        hit = data.find(MAGIC)
        while hit >= 0:
            hits.append(base + hit)
            hit = data.find(MAGIC, hit + 1)
        at = base + len(data)
        tail = data[-(len(MAGIC) - 1) :]
    # A version line that the end of the range cuts begins in it.
    source.seek(max(start, end - len(MAGIC) + 1))
    across = source.read(2 * len(MAGIC) - 2)
    hit = across.find(MAGIC)
    if hit >= 0 and (last := max(start, end - len(MAGIC) + 1) + hit) < end:
        hits.append(last)
    leads: dict[int, int] = {}
    for at, beyond in reversed(list(_successors(source, sorted(set(hits)), size))):
        leads[at] = leads.get(beyond, beyond)
    return sorted(leads.items())


def _walk(source, at: int, end: int, size: int, with_payload: bool) -> Iterator[tuple]:
    """The records of the chain from an offset as long as they begin before end."""
    while at < end and (head := _header(source, at, size)):
        source.seek(head.block)
        left, digest, length, kept, http = head.length, hashlib.sha1(), 0, [], b""
        skipping = head.fields.get("content-type", "").startswith("application/http")
        while left:
            piece = source.read(min(CHUNK, left))
            if not piece:
                break
            left -= len(piece)
            if skipping:
                http += piece
                cut = http.find(END.encode())
                if cut < 0:
                    continue
                piece, skipping = http[cut + len(END) :], False
            digest.update(piece)
            length += len(piece)
            if with_payload:
                kept.append(piece)
        yield head, length, digest.hexdigest(), b"".join(kept) if with_payload else None
        at = head.next


def _url(fields: dict[str, str]) -> str | None:
    encoded = fields.get("x-target-uri-encoded")
    return fields.get("warc-target-uri") if encoded is None else unquote_plus(encoded)


def _page_id(value: str | None) -> int | None:
    number = (value or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def read_warc(spark: SparkSession, path: str, split: int = SPLIT, with_payload: bool = False, strict: bool = False, names: str | None = None) -> DataFrame:
    """(path, offset, page_id, record_type, url, refers_to, payload_bytes, payload_digest, [payload]) of each reachable record.

    A revisit's length and digest are those of the full payload, from its header. If strict, a chain that ends before
    its file does is an error. All files under the path are read, or those whose names fit the pattern `names`.
    """
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", names) if names else reader).load(path).select("path", F.col("length").alias("size"))
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = written(ranges.withColumn("end", F.least(F.col("size"), F.col("start") + split)).repartition("path", "start"), "ranges")
    n = min(max(1, ranges.count()), MOST_TASKS)
    spread = ranges.repartition(n, "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    found = _candidates(source, row["start"], row["end"], row["size"])
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["path", "at", "to"])

    leads = written(spread.mapInArrow(scan, "path string, at long, to long"), "leads")
    # Only offsets that some chain enters matter; those inside a range are followed already.
    jumps = written(leads.join(leads.select("path", F.col("to").alias("at")).distinct(), ["path", "at"], "left_semi").union(leads.where("at = 0")).distinct(), "jumps")
    reached = written(leads.where("at = 0").select("path", "at").distinct(), "reached")
    count = reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at")).join(leads.select("path", "at"), ["path", "at"], "left_semi")
        reached = written(reached.union(ahead).distinct(), "reached")
        now = reached.count()
        if now == count:
            break
        count = now
        onward = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        two = jumps.join(onward, ["path", "to"], "left").select("path", "at", F.coalesce("beyond", "to").alias("to"))
        jumps = written(two, "jumps")
    if strict:
        ends = reached.join(leads, ["path", "at"]).groupBy("path").agg(F.max("to").alias("to"))
        short = files.where("size > 0").join(ends, "path", "left").where("to is null or to < size").select("path", F.coalesce("to", F.lit(0)).alias("to")).head()
        if short:
            raise ValueError(f"no record at byte {short['to']} of {short['path']}, before the file's end")
    # Ranges begin at multiples of split, so an entry meets its own range only.
    entries = reached.withColumn("start", F.expr(f"at div {split} * {split}")).join(ranges, ["path", "start"]).select("path", "size", "at", "end").repartition(n, "path", "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    for head, length, digest, payload in _walk(source, row["at"], row["end"], row["size"], with_payload):
                        kind = head.fields.get("warc-type")
                        if kind == "revisit":
                            length = int(head.fields.get("x-payload-length", length))
                            digest = head.fields.get("warc-payload-digest", "").removeprefix("sha1:") or digest
                        one = [row["path"], head.at, _page_id(head.fields.get("warc-record-id")), kind, _url(head.fields), _page_id(head.fields.get("warc-refers-to")), length, digest]
                        yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, one + [payload] * with_payload))], schema=SCHEMA if not with_payload else SCHEMA.append(pa.field("payload", pa.binary())))

    return entries.mapInArrow(walk, "path string, offset long, page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


FIELDS = ["path", "offset", "page_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
SCHEMA = pa.schema([(n, pa.int64() if n in ("offset", "page_id", "refers_to", "payload_bytes") else pa.string()) for n in FIELDS[:-1]])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, strict=True, names="part-*").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
