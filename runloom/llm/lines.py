"""Near-duplicate lines by a deletion-neighbourhood join.

The symbols of a line are its words (``unit="word"``) or the characters of its
words joined by single spaces (``unit="character"``); two lines are near when
one insertion, deletion or substitution of a symbol turns one into the other.
Every line gives the hashes of all its variants, itself and itself without one
symbol, as keys:

* lines of one length are near exactly when they give one variant without the
  same place, and all lines of such a key are near each other, so each is
  compared with the earliest of them only;
* a line is near a longer one exactly when it equals one of its variants.

So the join is linear in the number of variants however many lines share one.
The edit distance of each line and the earliest near line found is then
verified on the symbols. Where that fails, two variants had one hash; all lines
of the keys of such a line are then joined on the variants themselves, which
loses nothing. A line stays when no earlier line has the same symbols and no
earlier line is near it (whether or not that one stays).

Before that, lines that cannot have a near one are left out without loss: one
edit leaves the first or the last half of the shorter line as it is, so only
lines that share the hash of a half with another can be near it. The half of a
line of one symbol is empty, so all lines of one or two share it.

Defined cases: lines are split at line feeds, words at ASCII white space; lines
without words always stay; lines of fewer than ``least`` symbols are only
compared as equal (of words, three is the least length of which one edit leaves
most; any two lines of one word are one edit apart); a null text has one empty
line; the order is by id (null first), then a hash of the text, then line; equal
rows with one id keep the same lines; a very long line gives its variants' keys
one array at a time; an empty table gives an empty result. Only the id and the
text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import bounded_batches, bounded_broadcast, table, written

#: Least number of symbols of a line that is compared for nearness, by unit.
LEAST = {"word": 3, "character": 8}
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Rows of 8 to 24 bytes that may be broadcast: 24 MB in all.
BROADCAST_ROWS = 1_000_000
WHOLE = -1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _half(n: int) -> int:
    """Symbols of the half of a line of n, from 8 words in steps of four, so that neighbouring lengths mostly share it."""
    return n // 2 // 4 * 4 if n >= 8 else n // 2


def symbols(line: bytes, unit: str) -> list[bytes]:
    """The symbols of a line: its words, or the characters of its words joined by spaces."""
    words = line.split()
    return words if unit == "word" else [c.encode("utf-8", "surrogatepass") for c in b" ".join(words).decode("utf-8", "surrogatepass")]


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the first and last halves by which near lines of n - 1, n and n + 1 symbols can meet."""
    n, join = len(words), b" ".join
    halves = {_half(n), _half(n - 1)}
    return [_signed(xxhash.xxh64_intdigest(join(part), seed=2 * h + last)) for h in halves for last, part in ((0, words[:h]), (1, words[n - h :]))]


def variants(words: list[bytes]) -> np.ndarray:
    """Hashes of the line without symbol i for each i, and of the whole line at last.

    Each is a polynomial in BASE over the symbols' hashes, from sums before and after the gap.
    """
    n = len(words)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    power = np.ones(n, np.uint64)
    if n > 1:
        power[1:] = np.multiply.accumulate(np.full(n - 1, BASE, np.uint64))
    term = h * power
    upto = np.add.accumulate(term)
    without = (upto - term) + (upto[-1] - upto) * np.uint64(INVERSE)
    # The length tells apart lines that differ by words of hash zero.
    return np.concatenate([without + np.uint64(n - 1), [upto[-1] + np.uint64(n)]]).view(np.int64)


def edit_distance(a: list, b: list, bound: int) -> int:
    """Levenshtein distance of two sequences, or bound + 1 if it is greater."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)) if abs(i - j) <= bound else bound + 1)
        if min(row) > bound:
            return bound + 1
        before = row
    return min(before[-1], bound + 1)


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


PLACE = "d long, r long, l int"


def _place() -> Column:
    return F.struct("d", "r", "l")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("r"), text.alias("text"))


def _explode(docs: DataFrame, kind: str, names: list[str], row) -> DataFrame:
    """Rows row(words, line) of each line with words, after its place (d, r, l)."""
    schema = pa.schema([("d", pa.int64()), ("r", pa.int64()), ("l", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, r, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at, line in enumerate(split_lines(text)):
                    if words := line.split():
                        out.append((d, r, at, *row(words, line)))
            columns = list(zip(*out)) if out else [()] * (3 + len(names))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)] + [pa.array(c, TYPES[n]) for c, n in zip(columns[3:], names)]
            yield pa.RecordBatch.from_arrays(arrays, names=["d", "r", "l", *names])

    return bounded_batches(docs).mapInArrow(each, f"{PLACE}, {kind}")


TYPES = {"h1": pa.int64(), "h2": pa.int64(), "halves": pa.list_(pa.int64()), "line": pa.binary()}


def distinct_lines(docs: DataFrame, unit: str, least: int) -> DataFrame:
    """(d, r, l, h1, h2, halves): the earliest place of each distinct line, its 128-bit hash and the keys of its halves."""

    def row(words: list[bytes], line: bytes) -> tuple:
        whole, parts = b" ".join(words), words if unit == "word" else symbols(line, unit)
        return _signed(xxhash.xxh64_intdigest(whole)), _signed(xxhash.xxh64_intdigest(whole, seed=1)), half_keys(parts) if len(parts) >= least else []

    rows = _explode(docs, "h1 long, h2 long, halves array<long>", ["h1", "h2", "halves"], row)
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("d", "r", "l", "halves")).alias("first"))
    return first.select("first.*", "h1", "h2")


def _suspects(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(d, r, l, line) of the distinct lines that share a half with another.

    A half that very many lines share is one key, counted before it is shuffled; beyond the broadcast's bound the other
    side of the join has one row for it, and adaptive execution splits the lines'.
    """
    keyed = distinct.select("d", "r", "l", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    places = written(keyed.join(bounded_broadcast(written(shared, "halves"), BROADCAST_ROWS), "half", "left_semi").select("d", "r", "l").distinct(), "suspects")
    lines = _explode(docs, "line binary", ["line"], lambda words, line: (b" ".join(words),))
    same = [F.col("s." + c).eqNullSafe(F.col("p." + c)) for c in ("d", "r", "l")]
    found = lines.alias("s").join(bounded_broadcast(places, BROADCAST_ROWS).alias("p"), same, "left_semi")
    return found.dropDuplicates(["d", "r", "l"])  # equal rows with one id have one place


def _earlier(rows: DataFrame) -> DataFrame:
    """(at, other): for each line of rows(at, key, gap) the earliest earlier one that shares a variant so that they are near."""
    cut, whole = rows.where(F.col("gap") != WHOLE), rows.where(F.col("gap") == WHOLE)
    heads = cut.groupBy("key", "gap").agg(F.min("at").alias("other"), F.count("*").alias("n")).where("n > 1").drop("n")
    same_length = cut.join(heads, ["key", "gap"]).where("other < at").select("at", "other")
    longer = cut.select("key", F.col("at").alias("long")).join(whole.select("key", F.col("at").alias("short")), "key")
    longer = longer.select(F.greatest("long", "short").alias("at"), F.least("long", "short").alias("other")).where("other < at")
    return same_length.union(longer).groupBy("at").agg(F.min("other").alias("other"))


AT = f"struct<{PLACE.replace(' ', ':').replace(',:', ',')}>"


def near_lines(suspects: DataFrame, unit: str = "word") -> DataFrame:
    """(d, r, l, earlier): each line of suspects(d, r, l, line) that has an earlier near one, with such a one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = variants(symbols(batch.column(3)[i].as_py(), unit))
                gaps = np.append(np.arange(len(keys) - 1, dtype=np.int32), np.int32(WHOLE))
                take = pa.array(np.full(len(keys), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(keys), pa.array(gaps, pa.int32())], names=["d", "r", "l", "key", "gap"])

    rows = written(suspects.mapInArrow(emit, f"{PLACE}, key long, gap int").select(_place().alias("at"), "key", "gap"), "variants")
    lines = suspects.select(_place().alias("place"), "line")
    pairs = _earlier(rows).join(lines.select(F.col("place").alias("at"), F.col("line").alias("a")), "at")
    pairs = pairs.join(lines.select(F.col("place").alias("other"), F.col("line").alias("b")), "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance(symbols(a, unit), symbols(b, unit), 1) <= 1 for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["at", "other", "near"])

    checked = written(pairs.select("at", "other", "a", "b").mapInArrow(verify, f"at {AT}, other {AT}, near boolean"), "verified")
    found = checked.where("near").select("at", "other")
    doubtful = checked.where("not near").select("at")
    if doubtful.limit(1).count():
        found = found.union(_by_variants(rows, lines, doubtful, unit))
    return found.select("at.*", F.col("other").alias("earlier"))


def _by_variants(rows: DataFrame, lines: DataFrame, doubtful: DataFrame, unit: str) -> DataFrame:
    """_earlier of the lines in doubtful(at), by the bytes of the variants of all lines that share a key with them."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelt = []
            for gap, line in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = symbols(line, unit)
                left = parts if gap == WHOLE else parts[:gap] + parts[gap + 1 :]
                spelt.append(len(left).to_bytes(8, "big") + (b" " if unit == "word" else b"").join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelt, pa.binary()), batch.column(1)], names=["at", "key", "gap"])

    keys = written(rows.join(doubtful, "at", "left_semi").select("key").distinct(), "keys")
    some = rows.join(bounded_broadcast(keys, BROADCAST_ROWS), "key", "left_semi")
    some = some.join(lines.withColumnRenamed("place", "at"), "at").select("at", "gap", "line")
    spelt = written(bounded_batches(some).mapInArrow(spell, f"at {AT}, key binary, gap int"), "spelt")
    return _earlier(spelt).join(doubtful, "at", "left_semi")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "word", least: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_kept) of every row: its text without lines that repeat or nearly repeat an earlier one."""
    rows = _documents(docs, id_col, text_col)
    distinct = written(distinct_lines(rows, unit, LEAST[unit] if least is None else least), "lines")
    dropped = written(near_lines(written(_suspects(distinct, rows), "suspects"), unit), "near")
    places = [F.col("a." + c).eqNullSafe(F.col("b." + c)) for c in ("d", "r", "l")]
    stay = distinct.select("d", "r", "l").alias("a").join(dropped.select("d", "r", "l").alias("b"), places, "left_anti")
    stay = stay.groupBy("d", "r").agg(F.collect_list("l").alias("stay"))
    joined = rows.alias("x").join(stay.alias("y"), [F.col("x.d").eqNullSafe(F.col("y.d")), F.col("x.r") == F.col("y.r")], "left").select("x.d", "text", "stay")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, kept = [], [], []
            for text, stay in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held, lines = set(stay or ()), split_lines(text)
                left = [x for i, x in enumerate(lines) if i in held or not x.split()]
                texts.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
                sizes.append(len(lines))
                kept.append(len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(kept, pa.int64())], names=["doc_id", "text", "n_lines", "n_kept"])

    return bounded_batches(joined).mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_kept long")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_kept, text_sha256 of the text that is left)."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", F.sha2("text", 256).alias("text_sha256"))
