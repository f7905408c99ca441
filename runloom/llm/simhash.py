"""SimHash near-duplicate groups by pigeonhole blocks.

A document's fingerprint takes the majority of every bit over the 64-bit
hashes of its word shingles. Fingerprints are cut into ``max_bits + 2`` equal
blocks; two that differ in at most ``max_bits`` bits agree in at least two of
the blocks, so they meet in the join on one pair of blocks. Only distinct
fingerprints are joined, and candidates are verified by their Hamming distance.

A pair of blocks that more than ``bucket_limit`` fingerprints share would give
a number of pairs in the square of its size. There, each fingerprint instead
gives one key for each pair of cleared bits outside the shared blocks;
fingerprints within two bits have such a key in common and at most four
fingerprints can have one, so the links stay linear and none is lost. Other
``max_bits`` use the same keys with as many cleared bits.

Documents get their component by their fingerprint. Fingerprints of more than
``HOT`` documents (such as that of texts without words) do so in a join of their
own, to a table of at most a HOT-th of the rows, so none of them is shuffled to
one task as long as that table may be broadcast.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; equal rows (and rows with a null
id) keep their own row; texts of any length are read whole, by chunks of
shingles; an empty table gives an empty result. Columns other
than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import LOWER_AZ, bounded_batches, bounded_broadcast, table, written
from runloom.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted at once, which bounds the memory of a very long text.
CHUNK = 1 << 15
#: Documents beyond which a fingerprint is joined apart, and such fingerprints (16 bytes each) that may be broadcast.
HOT, BROADCAST_ROWS = 10_000, 1_000_000


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        hashes = [digest(join(words[i : i + width]), SEED) for i in range(at, min(n, at + CHUNK))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, whole texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(each, "doc_id long, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of max_bits + 2 blocks that cover 64 bits."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(max_bits: int) -> list[int]:
    """The bits kept by each pair of blocks."""
    ones = [((1 << bits) - 1) << shift for shift, bits in _blocks(max_bits)]
    return [a | b for a, b in combinations(ones, 2)]


def links(distinct: DataFrame, max_bits: int = 2, bucket_limit: int = 256) -> DataFrame:
    """(u, v): fingerprints of distinct(fp) whose links join all pairs within max_bits.

    Every pair is verified; in crowded blocks a path of links stands for the pairs.
    """
    masks = block_masks(max_bits)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("part", "key"))
    shared = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = written(keyed.join(shared, ["part", "key"]), "blocks")
    few = keyed.where(F.col("n") <= bucket_limit)
    pairs = (
        few.select("part", "key", F.col("fp").alias("u"))
        .join(few.select("part", "key", F.col("fp").alias("v")), ["part", "key"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
        .select("u", "v")
    )
    many = keyed.where(F.col("n") > bucket_limit)
    if not many.limit(1).count():
        return pairs
    for part, mask in enumerate(masks):
        free = [i for i in range(64) if not mask >> i & 1]
        cleared = [_signed(sum(1 << i for i in some)) for some in combinations(free, min(max_bits, len(free)))]
        rows = many.where(F.col("part") == part).select("fp", F.explode(F.lit(cleared)).alias("cleared"))
        near = rows.groupBy("cleared", F.col("fp").bitwiseAND(F.bitwise_not("cleared")).alias("rest")).agg(F.collect_set("fp").alias("fps"))
        near = near.where(F.size("fps") > 1).select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
        pairs = pairs.union(near)
    return pairs


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, bucket_limit: int = 256
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    component_id is the least id that links of at most max_bits differing bits
    reach, the row's own included.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits, bucket_limit))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    members = written(classes.join(least, "root").select("fp", "component_id", "n"), "members")
    hot, cold = members.where(F.col("n") > HOT).drop("n"), members.where(F.col("n") <= HOT).drop("n")
    if hot.limit(1).count():
        hot = bounded_broadcast(hot, BROADCAST_ROWS)
        found = fps.join(hot, "fp").unionByName(fps.join(hot.select("fp"), "fp", "left_anti").join(cold, "fp"))
    else:
        found = fps.join(cold, "fp")
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
