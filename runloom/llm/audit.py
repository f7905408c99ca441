"""Filter interaction audit: what each of five filters removes, alone and after others, in every order of them.

A first pass gives each document five bits, one for each filter, of which E (an
exact copy of a smaller id's text) is left open. Fingerprints (XXH64) that
occur once cannot be copies; the texts of the others are routed by fingerprint
in an RDD. Each partition, before and after the shuffle, stores collision
chains: for each fingerprint its different texts in full, each with the least
id seen. A row that meets a smaller id gives its own id out at once, so of any
number of copies only one for each partition is shuffled, and a task holds
different texts only. ``combineByKey`` then adds up, for each part (language),
a vector of counts by mask of failed filters; what any order of filters keeps
and removes follows from these 32 masks.

Defined cases: a null text counts as empty; a null language is the part named
''; a null id is compared with none, so it neither fails E nor makes another
fail; rows that share an id and a text fail E together; labels of one id count
if any row has them, documents without a label row count as neither; texts of
any length are one value each, handled whole in bounded batches; an empty table
gives no rows. Only id, text, language and the two labels are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import UPPER, bounded_batches, bounded_broadcast, table, written

LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
MASKS = 1 << len(LETTERS)
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
SYMBOLS = re.compile(rb"[#$%&*|]")
#: Bytes of text whose chains a partition holds before the shuffle; then it lets them go and starts anew.
HELD_BYTES = 64 << 20
#: Bytes of suspect texts for each partition after the shuffle.
ROUTED_BYTES = 32 << 20
#: Rows of (fp), (doc_id, digest) or labels that may be broadcast: 30 bytes each, 60 MB in all.
BROADCAST_ROWS = 1 << 21
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed_alone(data: bytes, characters: int) -> int:
    """Bits of the filters A to D that a text (in UTF-8) fails."""
    words = data.split()  # of bytes: at \x20 and \x09-\x0D only
    capitals = len(data) - len(data.translate(None, UPPER.encode()))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * characters, SYMBOLS.search(data) is not None)
    return sum(1 << i for i, x in enumerate(fails) if x)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(rows: DataFrame) -> DataFrame:
    """(doc_id, part, fp, bits, digest, bytes) of rows(doc_id, part, fp, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            data = texts.cast(pa.binary()).to_pylist()
            bits = [failed_alone(x, n) for x, n in zip(data, pc.utf8_length(texts).to_pylist())]
            columns = [pa.array(bits, pa.int32()), pa.array([_digest(x) for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "part", "fp", "bits", "digest", "bytes"])

    return bounded_batches(rows).mapInArrow(each, "doc_id long, part string, fp long, bits int, digest binary, bytes long")


def chained(records: Iterable[tuple[int, tuple]], held_bytes: float) -> Iterator[tuple[int, tuple]]:
    """Records (fp, (id, text)) as (fp, (least id, text)) of each different text, and (id, (id, None, digest)) of every larger id.

    Records of larger ids that come in are passed on.
    """
    chains: dict[int, list[list]] = {}
    held = 0
    for fp, value in records:
        if len(value) == 3:
            yield fp, value
            continue
        own, text = value
        for link in chains.setdefault(fp, []):
            if link[0] == text:
                if own != link[1]:
                    larger, link[1] = max(own, link[1]), min(own, link[1])
                    yield larger, (larger, None, _digest(text))
                break
        else:
            chains[fp].append([text, own])
            held += len(text)
        if held > held_bytes:
            yield from ((fp, (own, text)) for fp, chain in chains.items() for text, own in chain)
            chains, held = {}, 0
    yield from ((fp, (own, text)) for fp, chain in chains.items() for text, own in chain)


def later_copies(suspects: DataFrame, partitions: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, digest) of the rows of suspects(fp, doc_id, text) whose text a smaller id has too."""
    records = suspects.rdd.map(lambda r: (r["fp"], (r["doc_id"], bytes(r["text"]))))
    routed = records.mapPartitions(lambda rows: chained(rows, held_bytes)).partitionBy(partitions)
    larger = routed.mapPartitions(lambda rows: chained(rows, float("inf"))).filter(lambda r: len(r[1]) == 3)
    return suspects.sparkSession.createDataFrame(larger.map(lambda r: (r[1][0], bytearray(r[1][2]))), "doc_id long, digest binary").distinct()


def failed_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", fingerprint_bits: int = 64) -> DataFrame:
    """(part, mask, good, toxic) of every row of docs: the bits of the filters that it fails, E included, and its labels."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fp = F.shiftright(F.xxhash64(text), 64 - fingerprint_bits) if fingerprint_bits < 64 else F.xxhash64(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), fp.alias("fp"), text.alias("text"))
    seen = written(features(rows), "features")
    repeated = seen.where("doc_id IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("n > 1")
    repeated = written(repeated, "repeated")
    size = repeated.agg(F.sum("bytes")).first()[0]
    marked = seen.withColumn("copy", F.lit(False))
    if size is not None:
        # Texts go to the RDD as bytes, of which no decoding changes any.
        suspects = rows.where("doc_id IS NOT NULL").join(bounded_broadcast(repeated.select("fp"), BROADCAST_ROWS), "fp", "left_semi")
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // ROUTED_BYTES + 1)
        later = written(later_copies(suspects.select("fp", "doc_id", F.col("text").cast("binary").alias("text")), partitions), "later")
        later = bounded_broadcast(later.withColumn("copy", F.lit(True)), BROADCAST_ROWS)
        marked = seen.join(later, ["doc_id", "digest"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    joined = marked.join(bounded_broadcast(known, BROADCAST_ROWS), "doc_id", "left")
    mask = F.col("bits") + F.when(F.col("copy"), F.lit(COPY)).otherwise(F.lit(0))
    return joined.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _counted(counts: list[int], row: tuple) -> list[int]:
    """counts holds, for each mask, documents, good ones and toxic ones."""
    mask, good, toxic = row
    counts[3 * mask] += 1
    counts[3 * mask + 1] += good
    counts[3 * mask + 2] += toxic
    return counts


def audited(part: str, counts: list[int]) -> Iterator[tuple]:
    """The rows of RESULT of a part."""
    all_rows = sum(counts[::3])
    lost = {order: [] for order in ORDERS}
    shapley = dict.fromkeys(LETTERS, 0)
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << LETTERS.index(letter)
            here = [m for m in range(MASKS) if m & bit and not m & before]
            lost[order].append([sum(counts[3 * m + i] for m in here) for i in range(3)])
            shapley[letter] += lost[order][-1][0]
            before |= bit
    failing = {x: sum(counts[3 * m] for m in range(MASKS) if m >> i & 1) for i, x in enumerate(LETTERS)}
    for order in ORDERS:
        kept = all_rows
        for step, (letter, (removed, good, toxic)) in enumerate(zip(order, lost[order]), 1):
            kept -= removed
            yield part, order, step, kept, removed, failing[letter] - removed, counts[3 << LETTERS.index(letter)], good, toxic, shapley[letter]


def filter_audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each part, order of the filters and step; a part's rows follow from one vector of 96 counts."""
    marks = failed_filters(docs, labels, **options)
    vectors = marks.rdd.map(lambda r: (r["part"], (r["mask"], r["good"], r["toxic"]))).combineByKey(
        lambda row: _counted([0] * (3 * MASKS), row), _counted, lambda a, b: [x + y for x, y in zip(a, b)]
    )
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: audited(*x)), RESULT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS is_copy FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part,
  CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(is_copy AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, list_sum(bits[1:k]) - bits[k] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS k)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
