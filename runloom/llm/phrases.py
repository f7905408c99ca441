"""Phrase collocations by suffix sorting: every phrase of up to max_n words that is frequent, with the score of its weakest cut.

Words are counted by language first. The commonest of the frequent ones (at most
``dictionary``) get small numbers, which are broadcast. If these are all frequent
ones, any other word ends a run, as no frequent phrase can hold it; else the other
words go by a 63-bit hash of language and word, and words whose hashes would be
equal get numbers of their own. Either way a number stands for one word of one
language, so nothing is mistaken or lost.

Each word of a run begins a suffix, cut to max_n words. Tasks merge equal suffixes
of about GATHERED words at a time, and these are shuffled by language and first
word: tasks take ranges in the order of the suffixes, cut at quantiles of a sample
of documents, so first words too frequent for one task (or first pairs, and so on)
are shared by several. The sample only places the cuts. In each range Spark sorts
in reverse order, and one pass counts all prefixes by a stack of the open ones, one
for each length, whose prefixes end in each batch at once where the words change.
Whatever is open where a range begins or ends is given out as it is, at most
max_n - 1 prefixes each, and counts of equal phrases add up.

Joins afterwards find the two parts of every cut and the longer phrases around a
candidate. Products are decimals. The first of each language are ranked in two
steps, so that no task ranks all candidates of a language.

Defined cases: a null text counts as empty, a null language is `und` (as is the
language of that name); equal rows count as often as they occur; ids do not matter;
texts of any length are cut into stretches of CHUNK bytes between words, and runs
go on over them; ties are broken by smallest cut, then by phrase in byte order; an
empty table gives an empty result. Only text and language are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.common import LOWER_AZ, bounded_broadcast, commonest, place_of, table, written

ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z and makes every end of a piece a full stop, which no word holds.
PLAIN = bytes(ENDS[0] if i in ENDS else LOWER_AZ[i] for i in range(256))
END = ENDS[:1]
UNDETERMINED = "und"
#: Frequent words with numbers of their own: about 100 bytes each in a worker.
DICTIONARY = 1 << 19
#: Bytes of text that are split at once; words whose suffixes are merged at once; different words counted at once.
CHUNK, GATHERED, COUNTED = 1 << 20, 1 << 18, 1 << 18
#: Words of the documents whose suffixes place the cuts, and suffixes that a task gives of them.
SAMPLED, QUANTILES = 1 << 21, 1024
#: Words for each range.
RANGE = 1 << 22
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 4 << 20
#: Parts in which the candidates of a language are ranked first.
RANKED = 64
#: Rows (id, language, word, count) that may be broadcast: under 100 bytes each.
BROADCAST_ROWS = 1 << 17
HASHED = -(1 << 63)


def _batched(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stretches(batch: pa.RecordBatch, chunk: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words) of a batch (lang, text), a stretch at a time; END stands between pieces and after each text.

    Stretches of one language follow each other.
    """
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, own in texts.items():
        data = (END.join(own) + END).translate(PLAIN).replace(END, b" " + END + b" ")
        at = 0
        while at < len(data):
            end = data.find(b" ", at + chunk)
            end = len(data) if end < 0 else end
            yield lang, data[at:end].split()  # of bytes: at ASCII white space, of which space and tab are left
            at = end


def word_counts(rows: DataFrame, chunk: int = CHUNK, counted: int = COUNTED) -> DataFrame:
    """(lang, word, n) of every different word of rows(lang, text); word in bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(END, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, words in stretches(batch, chunk):
                held.setdefault(lang, Counter()).update(words)
                if sum(map(len, held.values())) > counted:
                    yield from given()
        yield from given()

    return _batched(rows).mapInArrow(each, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashed(lang: Column, word: Column, bits: int = 63) -> Column:
    return F.xxhash64(lang, word).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(HASHED))


class Numbers(dict):
    """The numbers of one language's words: those of the dictionary; others 0 if all frequent words are in it, else by hash."""

    def __init__(self, lang: str, known: dict[bytes, int], whole: bool, bits: int):
        super().__init__(known)
        self[END] = 0
        self.whole, self.mask, self.seed = whole, (1 << bits) - 1, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)

    def __missing__(self, word: bytes) -> int:
        return 0 if self.whole else (xxhash.xxh64_intdigest(word, self.seed) & self.mask) + HASHED


class Vocabulary:
    """What tasks need to number words; `known` has at most the dictionary's bound, and words of equal hashes."""

    def __init__(self, known: dict[str, dict[bytes, int]], whole: bool, bits: int):
        self.known, self.whole, self.bits = known, whole, bits
        self.of: dict[str, Numbers] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"of": {}}

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        if lang not in self.of:
            self.of[lang] = Numbers(lang, self.known.get(lang, {}), self.whole, self.bits)
        return np.fromiter(map(self.of[lang].__getitem__, words), np.int64, len(words))


def numbered(words: DataFrame, least: int, dictionary: int, bits: int) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and (id, lang, word, n) of the frequent words of words(lang, word, n)."""
    frequent = words.where(F.col("n") >= least)
    rows = sorted(commonest(frequent, dictionary), key=lambda r: (-r["n"], r["lang"], bytes(r["word"])))
    whole = not frequent.where(F.col("n") < (rows[-1]["n"] if rows else 1 << 62)).limit(1).count()
    known: dict[str, dict[bytes, int]] = {}
    if not whole:
        taken = words.sparkSession.createDataFrame([(r["lang"], r["word"]) for r in rows], "lang string, word binary")
        rest = words.join(F.broadcast(taken), ["lang", "word"], "left_anti").withColumn("id", hashed(F.col("lang"), F.col("word"), bits))
        rest = written(rest, "hashed")
        equal = rest.join(bounded_broadcast(rest.groupBy("id").count().where("count > 1").select("id"), BROADCAST_ROWS), "id", "left_semi")
        more = equal.limit(dictionary + 1).collect()
        if len(more) > dictionary:
            raise RuntimeError(f"more than {dictionary} words have equal hashes")
        rows += more
    for i, r in enumerate(rows, 1):
        known.setdefault(r["lang"], {})[bytes(r["word"])] = i
    ids = words.sparkSession.createDataFrame([(i, r["lang"], r["word"], r["n"]) for i, r in enumerate(rows, 1) if r["n"] >= least], "id long, lang string, word binary, n long")
    if not whole:
        alone = rest.join(equal.select("id").distinct(), "id", "left_anti")
        ids = ids.union(alone.where(F.col("n") >= least).select("id", "lang", "word", "n"))
    return Vocabulary(known, whole, bits), written(ids, "ids")


def suffixes(ids: np.ndarray, max_n: int) -> np.ndarray:
    """[places, max_n]: the words from each place on, 0 from the end of its run; those of at least two words."""
    padded = np.concatenate([ids, np.zeros(max_n, np.int64)])
    columns = [ids]
    for k in range(1, max_n):
        columns.append(np.where(columns[-1] == 0, 0, padded[k : k + len(ids)]))
    return np.stack(columns, axis=1)[(columns[0] != 0) & (columns[1] != 0)]


def ordered(rows: np.ndarray) -> np.ndarray:
    """Places of the rows in ascending order (stable); three numbers under 2^21 are compared as one."""
    if len(rows) and rows.min() >= 0 and rows.max() < 1 << 21:
        keys = []
        for a in range(0, rows.shape[1], 3):
            key = np.zeros(len(rows), np.int64)
            for column in rows[:, a : a + 3].T:
                key = (key << 21) | column
            keys.append(key)
    else:
        keys = list(rows.T)
    return np.lexsort(keys[::-1])


def merged(rows: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, row, count) of the different rows in order; a row equal to a cut belongs after it."""
    both = np.concatenate([cuts, rows])
    order = ordered(both)
    part = np.cumsum(order < len(cuts))
    real = order >= len(cuts)
    rows, part = both[order[real]], part[real]
    if not len(rows):
        return part, rows, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return part[starts], rows[starts], np.diff(np.append(starts, len(rows)))


def _names(max_n: int) -> list[str]:
    return [f"w{k}" for k in range(1, max_n + 1)]


def _kind(max_n: int) -> str:
    return ", ".join(f"{w} long" for w in _names(max_n)) + ", n long"


def suffix_rows(rows: DataFrame, shared, max_n: int, cuts: np.ndarray | None, chunk: int = CHUNK, gathered: int = GATHERED) -> DataFrame:
    """(part, w1, ..., n) of the suffixes of rows(lang, text), equal ones of a task merged; without cuts, at most QUANTILES a
    task at even distances, n being how many each stands for."""
    names = ["part", *_names(max_n), "n"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held, waiting, of = shared.value, [], 0, None

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            """Suffixes of what is held; unless it is the last, the words whose suffixes go on stay."""
            nonlocal held, waiting
            ids = np.concatenate(held) if held else np.zeros(0, np.int64)
            open_from = len(ids) if last else max(0, len(ids) - max_n + 1)
            found = suffixes(ids, max_n) if last else suffixes(ids, max_n)[: int(np.count_nonzero((ids[:open_from] != 0) & (ids[1 : open_from + 1] != 0)))]
            held, waiting = [ids[open_from:]], len(ids) - open_from
            part, found, n = merged(found, np.zeros((0, max_n), np.int64) if cuts is None else cuts)
            if cuts is None and len(found) > QUANTILES:
                at = np.arange(QUANTILES) * len(found) // QUANTILES
                part, found, n = part[at], found[at], np.full(QUANTILES, len(found) // QUANTILES)
            elif cuts is None:
                n = np.ones(len(found), np.int64)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(c) for c in found.T), pa.array(n, pa.int64())], names=names)

        for batch in batches:
            for lang, words in stretches(batch, chunk):
                held.append(vocabulary.numbers(lang, words))
                waiting += len(words)
                if waiting >= gathered:
                    yield from given(False)
        yield from given(True)

    return _batched(rows).mapInArrow(each, "part int, " + _kind(max_n))


def quantiles(rows: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """Different rows that cut the weights into as many even ranges or fewer."""
    if not len(rows):
        return rows
    order = ordered(rows)
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges))
    cuts = rows[order][np.minimum(at, len(rows) - 1)]
    return np.unique(cuts, axis=0) if len(cuts) else cuts


def prefix_counts(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of all prefixes of at least two words of suffixes (w1, ..., n) in reverse order.

    The stack has the open prefix of each length: its words, its count, and whether it was the first of the range.
    """
    stack: dict[int, tuple[np.ndarray, int, bool]] = {}
    names: list[str] = []

    def popped(words: np.ndarray, counts: np.ndarray, max_n: int) -> pa.RecordBatch:
        wide = np.zeros((len(words), max_n), np.int64)
        wide[:, : words.shape[1]] = words
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in wide.T), pa.array(counts, pa.int64())], names=names)

    max_n = 0
    for batch in batches:
        names = batch.schema.names
        max_n = len(names) - 1
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(max_n)], axis=1)
        n = batch.column(max_n).to_numpy(zero_copy_only=False)
        new = np.ones(len(rows), bool)  # whether the prefix so far differs from the row before
        new[1:] = rows[1:, 0] != rows[:-1, 0]
        for k in range(2, max_n + 1):
            new[1:] |= rows[1:, k - 1] != rows[:-1, k - 1]
            starts = np.flatnonzero(new)
            counts = np.add.reduceat(n, starts)
            own = rows[starts, :k]
            real = own[:, -1] != 0
            own, counts = own[real], counts[real]
            if not len(own):
                continue
            begun = k not in stack
            if not begun and (stack[k][0] == own[0]).all():
                counts[0] += stack[k][1]
                begun = stack[k][2]
            elif not begun and (stack[k][1] >= least or stack[k][2]):
                yield popped(stack[k][0][None, :], np.array([stack[k][1]]), max_n)
            whole = counts[:-1] >= least
            whole[:1] |= begun
            if whole.any():
                yield popped(own[:-1][whole], counts[:-1][whole], max_n)
            stack[k] = (own[-1], int(counts[-1]), begun and len(own) == 1)
    for words, count, _ in stack.values():
        yield popped(words[None, :], np.array([count]), max_n)


def frequent_phrases(rows: DataFrame, vocabulary: Vocabulary, total: int, least: int, max_n: int, chunk: int = CHUNK, gathered: int = GATHERED) -> DataFrame:
    """(w1, ..., n) of every phrase of 2 to max_n words with at least `least` occurrences in rows(lang, text) of `total` words."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE)
    some = rows.where(place_of(F.xxhash64("lang", "text")) < F.lit(min(1.0, SAMPLED / max(1, total))))
    sample = suffix_rows(some, shared, max_n, None, chunk, gathered).toArrow()
    places = np.stack([sample.column(w).to_numpy() for w in _names(max_n)], axis=1) if sample.num_rows else np.zeros((0, max_n), np.int64)
    cuts = quantiles(places, sample.column("n").to_numpy(), ranges)
    dealt = suffix_rows(rows, shared, max_n, cuts, chunk, gathered).repartitionById(len(cuts) + 1, F.col("part"))
    in_order = dealt.sortWithinPartitions(*[F.desc(w) for w in _names(max_n)]).drop("part")
    counts = in_order.mapInArrow(lambda batches: prefix_counts(batches, least), _kind(max_n))
    return counts.groupBy(*_names(max_n)).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _phrase(first: int, last: int, max_n: int) -> list[Column]:
    """Words first to last (from 0, last left out) of w1, ... as the words of a phrase of their own."""
    return [F.col(f"w{i + 1}") if i < last else F.lit(0).cast("long") for i in range(first, first + max_n)]


def _stretch(first: int, last: int, max_n: int, prefix: str = "w") -> Column:
    return F.struct(*[c.alias(f"{prefix}{i}") for i, c in enumerate(_phrase(first, last, max_n), 1)])


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = 4, least: int = 30, held_in: int = 80, top: int = 2000, dictionary: int = DICTIONARY, hash_bits: int = 63, chunk: int = CHUNK, gathered: int = GATHERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first `top` phrases of each language.

    A phrase of which a longer candidate around it has at least `held_in` percent of the occurrences is left out.
    """
    names = _names(max_n)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = written(word_counts(rows, chunk), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = words.agg(F.sum("n")).first()[0] or 0
    vocabulary, ids = numbered(words, least, dictionary, hash_bits)
    phrases = written(frequent_phrases(rows, vocabulary, total, least, max_n, chunk, gathered), "phrases")
    length = sum(((F.col(w) != 0).cast("int") for w in names), F.lit(0))
    phrases = phrases.withColumn("length", length)

    # Candidates that no longer candidate holds too often.
    inner = [F.when(F.col("length") == size, _stretch(a, a + part, max_n)) for size in range(3, max_n + 1) for part in range(2, size) for a in range(size - part + 1)]
    if inner:
        around = phrases.where("length > 2").select(F.explode(F.array_compact(F.array(*inner))).alias("p"), "n").groupBy("p").agg(F.max("n").alias("longer"))
        around = around.select(*[F.col(f"p.{w}").alias(w) for w in names], "longer")
        apart = phrases.join(around, names, "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(held_in) * F.col("n"))).drop("longer")
    else:
        apart = phrases

    # The two parts of every cut.
    single = ids.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in names[1:]], "n", "lang")
    counted = written(phrases.drop("length").withColumn("lang", F.lit(None).cast("string")).unionByName(single), "counted")
    cut = [F.when(F.col("length") > k, F.struct(F.lit(k).alias("k"), _stretch(0, k, max_n, "l").alias("first"), F.struct(*[F.when(F.lit(k + i) < F.col("length"), F.col(names[k + i]) if k + i < max_n else F.lit(0)).otherwise(F.lit(0)).cast("long").alias(f"r{i + 1}") for i in range(max_n)]).alias("rest"))) for k in range(1, max_n)]
    cuts = apart.select(*names, F.col("n").alias("a"), F.explode(F.array_compact(F.array(*cut))).alias("cut")).select(*names, "a", "cut.k", "cut.first.*", "cut.rest.*")
    left = counted.select(*[F.col(w).alias(f"l{i}") for i, w in enumerate(names, 1)], F.col("n").alias("l"), "lang")
    right = counted.select(*[F.col(w).alias(f"r{i}") for i, w in enumerate(names, 1)], F.col("n").alias("r"))
    parts = cuts.join(left, [f"l{i}" for i in range(1, max_n + 1)]).join(right, [f"r{i}" for i in range(1, max_n + 1)])
    score = F.expr("(CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    weakest = parts.withColumn("score", score).groupBy(*names, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("lang").alias("lang"))
    scored = weakest.select(*names, "lang", "a", "cut.l", "cut.r", "cut.score")

    # The first of each language, ties at the end included, in two steps; then in order of their words.
    best = [F.desc("score"), F.desc("a")]
    bucket = F.pmod(F.xxhash64(*names), F.lit(RANKED))
    scored = scored.withColumn("bucket", bucket).withColumn("place", F.rank().over(W.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("place") <= top)
    scored = scored.withColumn("place", F.rank().over(W.partitionBy("lang").orderBy(*best))).where(F.col("place") <= top).drop("place", "bucket")
    for w in names:
        scored = scored.join(ids.select(F.col("id").alias(w), F.col("word").alias(f"{w}_word")), w, "left")
    text = F.concat(F.col("w1_word"), *[F.when(F.col(w) == 0, F.lit(b"")).otherwise(F.concat(F.lit(b" "), F.col(f"{w}_word"))) for w in names[1:]])
    ranked = scored.withColumn("phrase", text.cast("string")).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best, "phrase")))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
h AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM s GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
x AS (SELECT cuts.lang, cuts.phrase, a, j, p1.f AS l, p2.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (p1.f + p2.f) AS BIGINT) AS score
  FROM cuts JOIN f p1 ON p1.lang = cuts.lang AND p1.phrase = first JOIN f p2 ON p2.lang = cuts.lang AND p2.phrase = rest),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT y.lang, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM y JOIN t ON t.lang = y.lang QUALIFY rank <= 2000
"""
