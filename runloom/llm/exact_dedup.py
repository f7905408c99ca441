"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter of its fingerprints: the
high bits of a 64-bit fingerprint (its quotient) select a run, the low bits
(its remainder) are kept sorted in that run, and each remainder has a counter.
Quotient and remainder together are the whole fingerprint, so filters merge
without loss by merging the sorted remainders of their runs. Filters are cut
into segments of quotients, one task merges a segment, and its size is bounded
by the expected number of fingerprints in it. So that the pieces stay of some
size, a filter is built from BUILD_ROWS fingerprints at least where there are so
many tasks. Fingerprints with a count above one route their documents to byte
verification, which groups by the whole normalised bytes.

Defined cases: a null text counts as empty; equal texts with equal ids are rows
of one group; a null id never stays unless all ids of its group are null; texts
of any length are hashed and compared whole, in bounded batches; an empty table
gives an empty result. Columns other than the id and the text are not read, so
their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import LOWER_AZ, bounded_batches, bounded_broadcast, table, written

#: Fingerprints expected in a merged segment of quotients.
SEGMENT = 1 << 20
#: Fingerprints (16 bytes each with their counters) of a partition's filter.
BUILD_ROWS = 1 << 22
#: Rows of (fingerprint) that may be broadcast: 16 bytes each, 32 MB in all.
BROADCAST_ROWS = 1 << 21
#: Quotient bits; whether runs are listed; first quotient; bits or runs; slots; slots with a counter.
HEAD = struct.Struct("<BBQQQQ")


class CountingQuotientFilter:
    """Sorted remainders with counters in slots, in runs by quotient.

    runs lists the quotients that have a run, ends the slot after each run's last.
    """

    def __init__(self, quotient_bits: int, runs: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits = quotient_bits
        self.runs, self.ends, self.remainders, self.counts = runs, ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(np.asarray(fingerprints, dtype=np.uint64), return_counts=True)
        low = np.uint64(64 - quotient_bits)
        runs, sizes = np.unique(values >> low, return_counts=True)
        return cls(quotient_bits, runs, np.cumsum(sizes), values & ((np.uint64(1) << low) - np.uint64(1)), counts.astype(np.int64))

    def _keys(self, quotients: np.ndarray) -> np.ndarray:
        """A number for each slot, ascending: the place of its run among the quotients, then its remainder."""
        place = np.repeat(np.searchsorted(quotients, self.runs), np.diff(self.ends, prepend=0)).astype(np.uint64)
        return place << np.uint64(64 - self.quotient_bits) | self.remainders

    @property
    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.runs, np.diff(self.ends, prepend=0)) << np.uint64(64 - self.quotient_bits) | self.remainders

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint is in, 0 if not."""
        low = 64 - self.quotient_bits
        run = int(np.searchsorted(self.runs, np.uint64(fingerprint >> low)))
        if run == len(self.runs) or int(self.runs[run]) != fingerprint >> low:
            return 0
        first, end = int(self.ends[run - 1]) if run else 0, int(self.ends[run])
        slot = first + int(np.searchsorted(self.remainders[first:end], np.uint64(fingerprint & ((1 << low) - 1))))
        return int(self.counts[slot]) if slot < end and int(self.remainders[slot]) == fingerprint & ((1 << low) - 1) else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The sorted remainders of the other's runs put among those of one's own; counters of equal ones add up."""
        if self.quotient_bits != other.quotient_bits:
            raise ValueError("filters of different quotients do not merge")
        runs = np.union1d(self.runs, other.runs)
        mine, new = self._keys(runs), other._keys(runs)
        at = np.searchsorted(mine, new)
        known = np.zeros(len(new), bool)
        if len(mine):
            known = mine[np.minimum(at, len(mine) - 1)] == new
        counts = self.counts.copy()
        counts[at[known]] += other.counts[known]
        keys, counts = np.insert(mine, at[~known], new[~known]), np.insert(counts, at[~known], other.counts[~known])
        low = np.uint64(64 - self.quotient_bits)
        ends = np.searchsorted(keys >> low, np.arange(len(runs), dtype=np.uint64), side="right")
        return CountingQuotientFilter(self.quotient_bits, runs, ends, keys & ((np.uint64(1) << low) - np.uint64(1)), counts)

    def segments(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(segment, bytes) by the highest bits of the quotient."""
        of = self.runs >> np.uint64(self.quotient_bits - bits)
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else []
        starts = np.concatenate([[0], self.ends])
        for a, b in zip(edges, edges[1:]):
            slots = slice(starts[a], starts[b])
            part = CountingQuotientFilter(self.quotient_bits, self.runs[a:b], self.ends[a:b] - starts[a], self.remainders[slots], self.counts[slots])
            yield int(of[a]), part.dump()

    def dump(self) -> bytes:
        """The filter as bytes: a bit for each quotient (or, of few runs, their list), a bit that ends each run, remainders
        in as few bytes as they need, and the counters above one by slot."""
        first = int(self.runs[0]) if len(self.runs) else 0
        runs = self.runs - np.uint64(first)
        span = int(runs[-1]) + 1 if len(runs) else 0
        sparse = span > 64 * len(runs)
        if sparse:
            occupied = runs.astype("<u8").tobytes()
        else:
            bits = np.zeros(span, bool)
            bits[runs.astype(np.int64)] = True
            occupied = np.packbits(bits).tobytes()
        last = np.zeros(len(self.remainders), bool)
        last[self.ends - 1] = True
        slots = np.flatnonzero(self.counts > 1)
        head = HEAD.pack(self.quotient_bits, sparse, first, len(runs) if sparse else span, len(self.remainders), len(slots))
        width = (64 - self.quotient_bits + 7) // 8
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        return head + occupied + np.packbits(last).tobytes() + packed + slots.astype("<u4").tobytes() + self.counts[slots].astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> CountingQuotientFilter:
        bits, sparse, first, span, n, repeated = HEAD.unpack_from(data)
        at = HEAD.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        runs = take(span, "<u8") if sparse else np.flatnonzero(np.unpackbits(take((span + 7) // 8, "u1"))[:span]).astype(np.uint64)
        ends = np.flatnonzero(np.unpackbits(take((n + 7) // 8, "u1"))[:n]) + 1
        width = (64 - bits + 7) // 8
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width, "u1").reshape(n, width)
        counts = np.ones(n, np.int64)
        slots = take(repeated, "<u4")
        counts[slots] = take(repeated, "<i8")
        return cls(bits, runs + np.uint64(first), ends, remainders.view("<u8").reshape(-1), counts)


def merged(parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """All filters as one; merged in pairs, so that each fingerprint is moved a logarithmic number of times."""
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
    return parts[0]


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(doc_id, fp, sha, [norm]) of every row: 64-bit fingerprint and SHA-256 of the normalised bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = [normalised(x.as_py()) for x in batch.column(1)]
            columns = [
                batch.column(0),
                pa.array([_signed(xxhash.xxh64_intdigest(x)) for x in norm], pa.int64()),
                pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary()),
            ]
            if with_bytes:
                columns.append(pa.array(norm, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "sha", "norm"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(each, "doc_id long, fp long, sha binary" + ", norm binary" * with_bytes)


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints of fps(fp) that occur more than once; rows is the number of rows of fps,
    from which the filters' number of quotients (at least one for each row) and of segments follow."""
    bits = (max(1, rows) // SEGMENT).bit_length()
    quotient_bits = min(48, max(8, rows.bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, rows_waiting = [], [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            rows_waiting += batch.num_rows
            if rows_waiting >= SEGMENT:
                parts.append(CountingQuotientFilter.build(np.concatenate(waiting), quotient_bits))
                waiting, rows_waiting = [], 0
        if waiting:
            parts.append(CountingQuotientFilter.build(np.concatenate(waiting), quotient_bits))
        cut = list(merged(parts).segments(bits)) if parts else []
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in cut], pa.int64()), pa.array([x for _, x in cut], pa.binary())], names=["segment", "filter"])

    def merge(segment: pa.Table) -> pa.Table:
        whole = merged([CountingQuotientFilter.load(x.as_py()) for x in segment.column("filter")])
        more = whole.counts > 1
        return pa.table({"fp": whole.fingerprints[more].view(np.int64), "n": whole.counts[more]})

    few = max(fps.sparkSession.sparkContext.defaultParallelism, rows // BUILD_ROWS)
    filters = fps.select("fp").coalesce(few).mapInArrow(build, "segment long, filter binary")
    return filters.groupBy("segment").applyInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs.

    Texts are equal when their bytes are, after lower-casing A-Z only. The row
    with the largest id of a group stays (every row with that id).
    """
    compact = written(digests(docs, id_col, text_col), "digests")
    repeated = written(repeated_fingerprints(compact, compact.count()), "repeated")
    suspects = digests(docs, id_col, text_col, with_bytes=True).join(bounded_broadcast(repeated.select("fp"), BROADCAST_ROWS), "fp", "left_semi")
    # Grouping by the bytes themselves is the verification: only equal bytes share a row.
    verified = suspects.groupBy("sha", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    verified = written(verified.where("group_size > 1").select("sha", "keep_id", "group_size"), "verified")
    if verified.count() != verified.select("sha").distinct().count():
        raise RuntimeError("two different texts have one SHA-256 digest; group by their bytes")
    out = compact.join(bounded_broadcast(verified, BROADCAST_ROWS // 4), "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
