"""Language-model scores: a log-bilinear neural model over word classes, trained in numpy by noise-contrastive estimation.

Words of the training documents are counted over all of them. The OUT commonest
words (the end of a text is one) are classes of their own; every other word,
known or not, belongs to one of BUCKETS classes by its last two bytes. A token's
probability is that of its class in context, by the neural model, times that of
the word in its class, by the counts (with 0.5 added, and one more word that
stands for all unknown ones); so probabilities of all words add up to one.

The model predicts a vector from those of the CONTEXT classes before a token, by
a matrix for each distance, and scores each class by the inner product with its
own vector, plus a bias. Noise-contrastive estimation needs no normalisation to
train: NOISE classes, drawn by their frequency for a batch, are told from the real
one. Training begins on stretches of STRETCH characters of a bounded sample of SAMPLE
documents; then, in rounds, each task trains on from the common model over every token of
all its training documents, and the tasks' models are averaged (in a tree, by their
numbers of tokens). Scoring normalises exactly, by products of matrices over ROWS tokens
at once.

The commonest words (all from some count on, DICTIONARY at most) and their counts are broadcast; other words of a
document are given out with their numbers and meet their counts in a join, so the
vocabulary has no bound. What is not in the dictionary is no hot key, as each such
word has less than 1 / DICTIONARY of all training tokens.

Defined cases: a null text counts as empty and has its end only; a null id is
learned from; equal rows are rows of their own; texts of any length are scored
whole, in stretches of CHUNK bytes with the context carried on; words of one count
rank in byte order; without training documents every token has probability one
and score is base_score; an empty table gives an empty result. Only id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import LOWER_AZ, bounded_batches, commonest, place_of, table, written

END = b""  # no word is empty
OUT, BUCKETS = 256, 128
CLASSES = OUT + BUCKETS
#: Stands before a text.
START = CLASSES
CONTEXT, WIDTH, NOISE = 4, 16, 48
#: Words whose counts are broadcast: about 100 bytes each in a worker.
DICTIONARY = 1 << 18
#: Documents of the first sample; characters of a stretch of them; rounds over all training documents, whole.
SAMPLE, STRETCH, ROUNDS = 4096, 320, 1
#: Examples that a task gathers before it trains on them, and those of a step: on the first sample, and on whole documents.
GATHERED, STEP, LONG_STEP = 1 << 15, 256, 1024
#: Bytes split at once, tokens looked up at once, tokens in one product.
CHUNK, TOKENS, ROWS = 1 << 20, 1 << 16, 512
#: Different words that a task counts before it gives them out.
COUNTED = 1 << 18
#: Share of a class that no word has; it is never drawn to speak of, and has probability zero.
NONE = 1e-12
LOG10 = np.log(10.0)


def held_out(id_col: Column) -> Column:
    """Whether a document takes no part in learning."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def split(data: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text, at least one list of them; the last one ends with END."""
    data = data.translate(LOWER_AZ)
    at = 0
    while (end := data.find(b" ", at + chunk)) >= 0:
        yield data[at:end].split()
        at = end
    yield [*data[at:].split(), END]


def token_counts(texts: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(word, n) of every different token of texts(text), in bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                for words in split(text):
                    held.update(words)
            if len(held) > counted:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return bounded_batches(texts).mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Places of the dictionary's words, commonest first; -1 - bucket for any other word.

    classes, counts and within (log10 of a word's probability in its class) are by
    place; rest is the denominator of each bucket.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, types: int, buckets: dict[int, tuple[int, int]]):
        super().__init__({w: i for i, w in enumerate(words)})
        self.tokens, self.types, self.counts = tokens, types, counts
        of = [bucket_of(w) for w in words]
        sizes = np.array([buckets.get(b, (0, 0)) for b in range(BUCKETS)], np.float64).reshape(BUCKETS, 2)
        for b, c in zip(of[:OUT], counts[:OUT]):  # words of their own are in no bucket
            sizes[b] -= (c, 1)
        self.rest = sizes[:, 0] + 0.5 * (sizes[:, 1] + 1)
        self.classes = np.array([i if i < OUT else OUT + b for i, b in enumerate(of)], np.int64)
        logs = np.log10(counts + 0.5)
        self.base = logs - np.log10(self.denominator)
        self.within = logs - np.log10(self.rest)[of] if words else logs
        self.within[:OUT] = 0
        shares = np.zeros(CLASSES)
        shares[: len(counts[:OUT])] = counts[:OUT] + 0.5
        shares[OUT:] = self.rest
        self.shares = shares / shares.sum()

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def __missing__(self, word: bytes) -> int:
        return -1 - bucket_of(word)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def class_of(self, places: np.ndarray) -> np.ndarray:
        return np.where(places < 0, OUT - 1 - places, self.classes[np.maximum(places, 0)]) if len(self) else OUT - 1 - places

    def __reduce__(self):
        return (_vocabulary, (list(self), self.__dict__))


def _vocabulary(words: list[bytes], state: dict) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    out.update({w: i for i, w in enumerate(words)})
    out.__dict__.update(state)
    return out


def vocabulary_of(words: DataFrame, dictionary: int = DICTIONARY) -> Vocabulary:
    """Of words(word, n): at most `dictionary` rows and the sums of BUCKETS buckets reach the driver."""
    bucket = F.pmod(F.crc32(F.substring(F.col("word"), -2, 2)), F.lit(BUCKETS))
    sizes = {r["b"]: (r["n"], r["v"]) for r in words.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    first = sorted(commonest(words, dictionary), key=lambda r: (-r["n"], bytes(r["word"])))
    return Vocabulary([bytes(r["word"]) for r in first], np.array([r["n"] for r in first], np.float64), sum(n for n, _ in sizes.values()), sum(v for _, v in sizes.values()), sizes)


def sums_of(places: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums [n, WIDTH] of the rows of each place; by bincount, which takes a quarter of the time of add.at."""
    return np.bincount((places[:, None] * WIDTH + np.arange(WIDTH)).ravel(), rows.ravel(), n * WIDTH).reshape(n, WIDTH)


class Model:
    """Vectors of classes before and at a token, a matrix for each distance, and biases."""

    NAMES = ("given", "mix", "out", "bias")
    #: What the last round trained on.
    tokens = 0

    def __init__(self, shares: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.given = rng.normal(0, 0.3, (CLASSES + 1, WIDTH))
        self.mix = np.stack([np.eye(WIDTH) / (j + 1) for j in range(CONTEXT)])
        self.out = rng.normal(0, 0.1, (CLASSES, WIDTH))
        self.noise = np.where(shares > 0, shares, NONE / 2)
        self.noise /= self.noise.sum()
        self.bias = np.log(self.noise)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def moved(self, vector: np.ndarray) -> Model:
        """This model with its parameters in a vector."""
        out, at = Model.__new__(Model), 0
        out.noise = self.noise
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(out, n, vector[at : at + old.size].reshape(old.shape).copy())
            at += old.size
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, valued: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """The objective of noise-contrastive estimation (mean over the examples) and its gradients. Unless valued,
        it is nan, and the part of the noise is in single precision.

        context [n, CONTEXT] (nearest first) and target [n] are classes; noise has the drawn ones.
        """
        n, k = len(target), len(noise)
        before = [self.given[context[:, j]] for j in range(CONTEXT)]
        q = sum(x @ m for x, m in zip(before, self.mix))
        expected = np.log(k * self.noise)
        real = np.einsum("ij,ij->i", q, self.out[target]) + self.bias[target] - expected[target]
        kind = np.float64 if valued else np.float32
        false = q.astype(kind) @ self.out[noise].T.astype(kind) + (self.bias[noise] - expected[noise]).astype(kind)
        value = -(np.logaddexp(0, -real).sum() + np.logaddexp(0, false).sum()) / n if valued else np.nan
        up, down = 1 / (1 + np.exp(np.clip(real, -500, 500))) / n, -1 / (1 + np.exp(np.clip(-false, -80, 80))) / n
        g = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        dq = up[:, None] * self.out[target] + down @ self.out[noise]
        g["out"] = sums_of(target, up[:, None] * q, CLASSES) + sums_of(noise, down.T @ q, CLASSES)
        g["bias"] = np.bincount(target, up, CLASSES) + np.bincount(noise, down.sum(axis=0), CLASSES)
        for j in range(CONTEXT):
            g["mix"][j] = before[j].T @ dq
            g["given"] += sums_of(context[:, j], dq @ self.mix[j].T, CLASSES + 1)
        return value, g

    def trained(self, context: np.ndarray, target: np.ndarray, rate: float, squares: dict[str, np.ndarray], rng: np.random.Generator, step: int = STEP) -> None:
        """One pass over the examples in random order, by AdaGrad; squares are its sums so far."""
        order = rng.permutation(len(target))
        for at in range(0, len(order), step):
            some = order[at : at + step]
            _, g = self.gradients(context[some], target[some], rng.choice(CLASSES, NOISE, p=self.noise), valued=False)
            for name, x in g.items():
                squares[name] = squares.get(name, 1e-8) + x * x
                setattr(self, name, getattr(self, name) + rate * x / np.sqrt(squares[name]))

    def compiled(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The model in single precision; a table for each distance has the vectors already turned."""

    def __init__(self, model: Model):
        self.tables = [np.ascontiguousarray(model.given @ m, np.float32) for m in model.mix]
        self.out = np.ascontiguousarray(model.out.T, np.float32)
        self.bias = np.where(model.noise > NONE, model.bias, -np.inf).astype(np.float32)

    def log10(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class at the places `at`, given the CONTEXT ones before it."""
        found, ones = np.empty(len(at)), np.ones(self.out.shape[1], np.float32)
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            q = self.tables[0][classes[some - 1]]
            for j in range(1, CONTEXT):
                q += self.tables[j][classes[some - 1 - j]]
            scores = q @ self.out
            scores += self.bias
            scores -= scores.max(axis=1, keepdims=True)
            own = scores[np.arange(len(some)), classes[some]].astype(np.float64)
            np.exp(scores, out=scores)
            found[a : a + ROWS] = (own - np.log((scores @ ones).astype(np.float64))) / LOG10
        return found


def stretches(learned: DataFrame, turn: int) -> DataFrame:
    """(h, piece, begins, ends) of learned(h, text): STRETCH characters at a hashed place, and whether the text begins or ends there."""
    size = F.length("text")
    at = (F.pmod(F.xxhash64("h", F.lit(turn)), F.greatest(size - STRETCH + 1, F.lit(1))) + 1).cast("int")
    return learned.withColumn("at", at).select("h", F.substring("text", F.col("at"), F.lit(STRETCH)).alias("piece"), (F.col("at") == 1).alias("begins"), (F.col("at") + STRETCH > size).alias("ends"))


def examples(vocabulary: Vocabulary, piece: bytes, begins: bool, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """(context, target) of the whole words of a piece; words cut off at its ends are left out."""
    words = [w for part in split(piece) for w in part][:-1]
    if not begins and words and piece[:1] not in b" \t\n\x0b\x0c\r":
        words = words[1:]
    if not ends and words and piece[-1:] not in b" \t\n\x0b\x0c\r":
        words = words[:-1]
    classes = vocabulary.class_of(vocabulary.places(words + [END] * ends))
    if begins:
        classes = np.concatenate([np.full(CONTEXT, START), classes])
    n = max(0, len(classes) - CONTEXT)
    return np.stack([classes[CONTEXT - 1 - j : CONTEXT - 1 - j + n] for j in range(CONTEXT)], axis=1), classes[CONTEXT : CONTEXT + n]


def text_examples(vocabulary: Vocabulary, text: bytes, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context, target) of every token of a whole text, some of them at a time."""
    before = np.full(CONTEXT, START)
    for words in split(text, chunk):
        classes = np.concatenate([before, vocabulary.class_of(vocabulary.places(words))])
        n, before = len(words), classes[-CONTEXT:]
        yield np.stack([classes[CONTEXT - 1 - j : CONTEXT - 1 - j + n] for j in range(CONTEXT)], axis=1), classes[CONTEXT:]


def fit(learned: DataFrame, vocabulary: Vocabulary, documents: int, shared, sample: int = SAMPLE, passes: int = 4, rounds: int = ROUNDS, rate: float = 0.1) -> Model:
    """Train on learned(h, text) of so many documents: on stretches of `sample` of them first, then in rounds on every token of all."""
    model, rng = Model(vocabulary.shares), np.random.default_rng(4)
    some = learned.where(place_of(F.col("h")) < F.lit(min(2.0, 2 * sample / max(1, documents))))
    rows = stretches(some, 0).orderBy("h", "piece").limit(sample).collect()
    found = [examples(vocabulary, r["piece"].encode("utf-8", "surrogatepass"), r["begins"], r["ends"]) for r in rows]
    context, target = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    squares: dict[str, np.ndarray] = {}
    for _ in range(passes):
        model.trained(context, target, rate, squares, rng)
    for turn in range(1, rounds + 1):
        start, begun = learned.sparkSession.sparkContext.broadcast((model, squares)), turn

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (first, known), own = start.value, shared.value
            mine, squares, rng = first.moved(first.vector()), {k: v.copy() for k, v in known.items()}, np.random.default_rng(begun)
            held, waiting, tokens = [], 0, 0
            found = (e for batch in batches for text in batch.column(0).cast(pa.binary()).to_pylist() for e in text_examples(own, text))
            for e in found:
                held.append(e)
                waiting += len(e[1])
                if waiting >= GATHERED:
                    mine.trained(np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held]), rate, squares, rng, LONG_STEP)
                    held, waiting, tokens = [], 0, tokens + waiting
            if waiting:
                mine.trained(np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held]), rate, squares, rng, LONG_STEP)
            if tokens + waiting:
                yield pa.RecordBatch.from_pydict({"tokens": [tokens + waiting], "model": [mine.vector().astype("<f8").tobytes()]})

        models = bounded_batches(learned.select("text")).mapInArrow(each, "tokens long, model binary").rdd
        sums = models.map(lambda r: (r["tokens"], r["tokens"] * np.frombuffer(bytes(r["model"]), "<f8")))
        zero = (0, np.zeros(len(model.vector())))
        tokens, total = sums.treeAggregate(zero, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]))
        if tokens:
            model = model.moved(total / tokens)
            model.tokens = tokens
    return model


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, others array<struct<word: binary, n: long>>"


def score_rows(rows: DataFrame, shared, scorer: Scorer | None, chunk: int = CHUNK) -> DataFrame:
    """rows(row, doc_id, held_out, text) as SCORED: sums over the tokens without log10(c + 0.5) of the words that are not in
    the dictionary, which are in `others`. Without a scorer only the base is summed."""
    word = pa.struct([("word", pa.binary()), ("n", pa.int64())])
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("others", pa.list_(word))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = shared.value
        denominator, rests = np.log10(own.denominator), np.log10(own.rest)
        for batch in batches:
            n, known = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            base, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            others = [Counter() for _ in range(batch.num_rows)]
            held: list[tuple[int, np.ndarray, np.ndarray]] = []  # row, places, classes with the context before them

            def flush() -> None:
                if not held:
                    return
                of, places = np.repeat([i for i, _, _ in held], [len(p) for _, p, _ in held]), np.concatenate([p for _, p, _ in held])
                near = places >= 0
                safe = np.where(near, places, 0)
                parts = np.where(near, own.base[safe], -denominator) if len(own) else np.full(len(places), -denominator)
                base[:] += np.bincount(of, parts, batch.num_rows)
                known[:] += np.bincount(of, near, batch.num_rows).astype(np.int64)
                n[:] += np.bincount(of, minlength=batch.num_rows)
                if scorer is not None:
                    classes = np.concatenate([c for _, _, c in held])
                    real = np.ones(len(classes), bool)
                    for j in range(CONTEXT):
                        real[np.cumsum([0, *(len(c) for _, _, c in held[:-1])]) + j] = False
                    words = np.where(near, own.within[safe], -rests[np.where(near, 0, -1 - places)])
                    score[:] += np.bincount(of, scorer.log10(classes, np.flatnonzero(real)) + words, batch.num_rows)
                held.clear()

            waiting = 0
            for i, text in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                before = np.full(CONTEXT, START)
                for words in split(text, chunk):
                    places = own.places(words)
                    others[i].update(words[j] for j in np.flatnonzero(places < 0))
                    classes = np.concatenate([before, own.class_of(places)])
                    before = classes[-CONTEXT:]
                    held.append((i, places, classes))
                    waiting += len(words)
                    if waiting >= TOKENS:
                        flush()
                        waiting = 0
            flush()
            lists = pa.array([[{"word": w, "n": c} for w, c in x.items()] for x in others], pa.list_(word))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(known), pa.array(base), pa.array(score), lists], schema=kinds)

    return bounded_batches(rows).mapInArrow(each, SCORED)


def token_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", neural: bool = True, dictionary: int = DICTIONARY, chunk: int = CHUNK, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text.alias("text"))
    learned = rows.where(~F.col("held_out"))
    words = written(token_counts(learned.select("text")), "tokens")
    vocabulary = vocabulary_of(words, dictionary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    scorer = None
    if neural and vocabulary.tokens:
        documents = int(vocabulary.counts[vocabulary[END]]) if vocabulary[END] >= 0 else vocabulary.tokens
        scorer = fit(learned.select(F.xxhash64("doc_id", "text").alias("h"), "text"), vocabulary, documents, shared, **options).compiled()
    scored = written(score_rows(rows.select(F.monotonically_increasing_id().alias("row"), "*"), shared, scorer, chunk), "scored")
    # Words that are not in the dictionary, all of them rarer than its last, meet their counts.
    most = float(vocabulary.counts[-1]) - 1 if len(vocabulary) else float("inf")
    others = scored.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("often"))
    logs = others.join(words.where(F.col("n") <= most), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = logs.groupBy("row").agg(F.sum(F.col("often") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("often")).otherwise(0)).alias("known"))
    joined = scored.drop("others").join(sums, "row", "left")
    more, base = F.coalesce("more", F.lit(0.0)), F.col("base") + F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + more if scorer else base).alias("score"),
    )


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scores(table(spark, sf_dir, "documents"))


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the scores that SQL can say, by counts alone: base_score in thousandths."""
    rows = token_scores(table(spark, sf_dir, "documents"), neural=False)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round(F.col("base_score") * 1000).cast("long").alias("base_thousandths"))


BASE_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS words,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, crc[CAST((xor(a, b) & 255) + 1 AS INT)])), 4294967295) % 5 = 1 AS held_out FROM documents, k),
t AS (SELECT doc_id, held_out, unnest(words) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
n AS (SELECT CAST(sum(c) AS BIGINT) AS tokens, count(*) AS types FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, tokens AS train_tokens,
  CAST(round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (tokens + 0.5::DOUBLE * (types + 1)))) * 1000) AS BIGINT) AS base_thousandths
FROM t LEFT JOIN c USING (word), n GROUP BY doc_id, held_out, tokens
"""
