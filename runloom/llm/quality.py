"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote on every text (good, bad or nothing). They overlap and
err, so expectation-maximisation estimates for each how often it votes and how
often it is right, and from that the posterior of each pattern of votes. The
sums of its steps run over the counts of the patterns in all documents, of
which there are at most 3 ** len(LABELLERS). Posteriors are the soft labels of a
logistic scorer over hashed byte n-grams, fitted on a bounded sample
(``sample`` documents that differ) and applied to whole texts.

The labellers know faults of prose: too few letters, too many symbols, digits or
capitals, words or lines that repeat, tokens that are no words, lines that do not
end; ``bars``, ``shouts``, ``marked`` and ``runs`` name single kinds of junk. The
scorer learns the kinds that its sample holds; of others it knows little (README
has figures).

Defined cases: a null text counts as empty; a text without words is no good
text (score 0); equal rows stay and count in the statistics as often as they
are there; ids may be null or repeat, as the sample is drawn by a hash of id and
text; very long texts are looked at whole, their n-grams by chunks; an empty
table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.common import bounded_batches, place_of, table, written

SAMPLE = 4_000
#: Share of the sample that is drawn from all patterns of votes alike.
ALIKE = 0.25
FEATURES = 2_048
GRAM = 4
#: Bytes whose n-grams are hashed at once, which bounds the memory of a very long text.
CHUNK = 1 << 20
GOOD, BAD, ABSTAIN = 1, -1, 0

_ALL = np.arange(256)
_SPACE = np.isin(_ALL, list(b" \t\n\x0b\x0c\r"))
#: Bytes of words: letters and digits, and all of characters beyond ASCII.
_WORD = (_ALL >= 128) | np.array([bytes([c]).isalnum() for c in range(256)])
_SYMBOL, _CLOSING, _OPENING = (np.isin(_ALL, list(x)) for x in (b"#$%&*+/<=>@\\^_`{|}~", b".,;:!?)\"'", b"(\"'"))


def rims(data: bytes, chunk: int = CHUNK) -> int:
    """Odd rims of tokens: a token of no word byte; one that ends in two such bytes, or in one that closes nothing; one that
    begins with one that opens nothing."""
    n, padded = 0, b" " + data + b" "
    for at in range(1, len(data) + 1, chunk):
        b = np.frombuffer(padded, np.uint8)[at - 1 : at + chunk + 1]
        here, odd, space = b[1:-1], ~_WORD[b], _SPACE[b]
        inside = ~space[1:-1]
        first, last = inside & space[:-2], inside & space[2:]
        lone = first & last & odd[1:-1]
        n += int(lone.sum())
        n += int((last & ~first & odd[1:-1] & (~_CLOSING[here] | odd[:-2])).sum())
        n += int((first & ~last & odd[1:-1] & ~_OPENING[here]).sum())
    return n


def _shares(data: bytes) -> dict[str, float]:
    """What the labellers look at; data holds at least one word."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    single = sum(np.bincount(np.frombuffer(data[at : at + CHUNK], np.uint8), minlength=256) for at in range(0, len(data), CHUNK))
    beyond = int(single[192:].sum())  # characters beyond ASCII, taken to be letters
    chars = int(single[:128].sum()) + beyond
    capitals = int(single[65:91].sum())
    letters = capitals + int(single[97:123].sum()) + beyond
    solid = chars - int(single[_SPACE].sum())
    return {
        "words": len(words),
        "digits": int(single[48:58].sum()) / max(1, solid),
        "length": solid / len(words),
        "longest": max(map(len, words)),
        "lines": len(lines),
        "fresh": len(set(lines)) / len(lines),
        "symbols": int(single[_SYMBOL].sum()) / chars,
        "capitals": capitals / max(1, letters),
        "letters": letters / chars,
        "distinct": min(1.0, len(set(words)) / min(len(words), 200)),  # a long text repeats its words anyway
        "runs": sum(map(operator.eq, words, words[1:])) / len(words),
        "rims": rims(data) / len(words),
        "ends": sum(x.rstrip()[-1:] in b".!?\"')" for x in lines) / len(lines),
    }


#: Most labellers only know a fault and say nothing otherwise.
LABELLERS = {
    "symbols": lambda s: BAD if s["symbols"] > 0.04 else ABSTAIN,
    "capitals": lambda s: BAD if s["words"] >= 5 and s["capitals"] > 0.5 else ABSTAIN,
    "distinct": lambda s: BAD if s["words"] >= 20 and s["distinct"] < 0.25 else ABSTAIN,
    "runs": lambda s: BAD if s["words"] >= 5 and s["runs"] > 0.1 else ABSTAIN,
    "rims": lambda s: BAD if s["rims"] > 0.15 else ABSTAIN,
    "digits": lambda s: BAD if s["digits"] > 0.3 else ABSTAIN,
    "tokens": lambda s: BAD if s["words"] >= 3 and (s["length"] > 20 or s["length"] < 1.5) or s["longest"] > 100 and s["words"] < 50 else ABSTAIN,
    "again": lambda s: BAD if s["lines"] >= 4 and s["fresh"] < 0.5 else ABSTAIN,
    "letters": lambda s: BAD if s["letters"] < 0.6 else GOOD if s["letters"] >= 0.75 else ABSTAIN,
    "ends": lambda s: BAD if s["words"] >= 5 and s["ends"] < 0.2 else GOOD if s["ends"] >= 0.6 else ABSTAIN,
    "plain": lambda s: GOOD if max(s["symbols"], s["rims"], s["runs"]) < 0.02 and s["capitals"] < 0.2 and (s["words"] < 20 or s["distinct"] > 0.4) else ABSTAIN,
}


def votes(text: str | None) -> tuple[int, ...]:
    """The votes of all labellers on a text; one without words is bad to all."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data.strip():
        return (BAD,) * len(LABELLERS)
    shares = _shares(data)
    return tuple(vote(shares) for vote in LABELLERS.values())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def pattern_of(told: tuple[int, ...]) -> int:
    code = 0
    for v in told:
        code = 3 * code + v + 1
    return code


def patterns(hashed: DataFrame) -> DataFrame:
    """(h, pattern) of every row of hashed(h, text): the votes as digits to the base of three."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pattern_of(votes(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], names=["h", "pattern"])

    return hashed.mapInArrow(each, "h long, pattern int")


class LabelModel:
    """For each labeller and class the probabilities of its votes (bad, nothing, good); the share of good texts."""

    def __init__(self, labellers: int):
        self.labellers, self.good = labellers, 0.7
        # Labellers are taken to be better than chance at first, which fixes what the classes mean.
        self.of_good = np.tile([0.1, 0.3, 0.6], (labellers, 1))
        self.of_bad = np.tile([0.4, 0.4, 0.2], (labellers, 1))

    def digits(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, None] // 3 ** np.arange(self.labellers - 1, -1, -1) % 3

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """The probability that a text with each pattern is good."""
        d, at = self.digits(codes), np.arange(self.labellers)
        good = np.log(self.good) + np.log(self.of_good[at, d]).sum(axis=1)
        bad = np.log(1 - self.good) + np.log(self.of_bad[at, d]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def fit(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
        """Expectation-maximisation over the counts of the patterns."""
        d = self.digits(codes)
        for _ in range(rounds):
            p = self.posterior(codes)
            before = self.good
            self.good = float(np.clip((p * counts).sum() / counts.sum(), 1e-3, 1 - 1e-3))
            for table_, mass in ((self.of_good, p * counts), (self.of_bad, (1 - p) * counts)):
                for v in range(3):
                    table_[:, v] = ((d == v) * mass[:, None]).sum(axis=0) + smooth
                table_ /= table_.sum(axis=1, keepdims=True)
            if abs(self.good - before) < 1e-9:
                break
        return self

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        right = self.good * self.of_good[:, 2] + (1 - self.good) * self.of_bad[:, 0]
        return right / (right + self.good * self.of_good[:, 0] + (1 - self.good) * self.of_bad[:, 2])


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's byte n-grams, by their hashes, and of its bytes; at last, how far words and n-grams repeat."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts, single = np.zeros(FEATURES, np.int64), np.zeros(256, np.int64)
    for at in range(0, max(0, len(data) - GRAM + 1), CHUNK):
        codes = np.frombuffer(data[at : at + CHUNK + GRAM - 1], np.uint8).astype(np.uint32)
        h = np.zeros(len(codes) - GRAM + 1, np.uint32)
        for i in range(GRAM):
            h = h * np.uint32(257) + codes[i : i + len(h)]
        counts += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    for at in range(0, len(data), CHUNK):
        single += np.bincount(np.frombuffer(data[at : at + CHUNK], np.uint8), minlength=256)
    shares = counts / max(1, counts.sum())
    words = data.split()
    runs = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    return np.concatenate([np.sqrt(shares), np.sqrt(single / max(1, len(data))), [np.sqrt(runs), np.sqrt((shares * shares).sum())]]).astype(np.float32)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, soft: np.ndarray, weights: np.ndarray | None = None, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
        """Logistic regression on soft labels by Adam over the whole sample, whose rows may weigh differently."""
        x, soft = x.astype(np.float32, copy=False), soft.astype(np.float32)
        weigh = np.ones(len(x), np.float32) if weights is None else (weights / weights.mean()).astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
        m, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
            off = (p - soft) * weigh
            g = np.append(off @ x / np.float32(len(x)) + np.float32(decay) * w, off.mean())
            m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.999) * v + np.float32(0.001) * g * g
            step = np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.999**t))) + np.float32(1e-8))
            w, b = w - step[:-1], b - step[-1]
        return cls(w, float(b))

    def score(self, text: str | None) -> float:
        if not (text or "").strip():
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(features(text) @ self.weights + self.bias, -50, 50))))


def quotas(sizes: np.ndarray, sample: int) -> np.ndarray:
    """How many of each pattern to draw: a part of the sample alike, the rest in proportion to their sizes, where there are so many."""
    return np.minimum(sizes, np.ceil(sample * (1 - ALIKE) * sizes / sizes.sum() + sample * ALIKE / len(sizes)))


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, Scorer] | None:
    """The label model of all rows of docs, and a scorer fitted on about `sample` documents: of each pattern of votes, those with
    the least hashes of id and text."""
    hashed = _rows(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    told = written(patterns(hashed), "votes")
    counted = sorted(told.groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("differ")).collect(), key=lambda r: r["pattern"])
    if not counted:
        return None
    codes, counts, differ = (np.array([r[c] for r in counted], kind) for c, kind in (("pattern", np.int64), ("n", float), ("differ", float)))
    model = LabelModel(len(LABELLERS)).fit(codes, counts)
    # About twice what is wanted lies below each pattern's bound; equal rows have one hash and are drawn once.
    wanted = quotas(differ, sample)
    bounds = docs.sparkSession.createDataFrame([(int(p), int(q), float(2 * q / d if d > 4 * q else 2.0)) for p, q, d in zip(codes, wanted, differ)], "pattern int, wanted long, share double")
    below = told.join(F.broadcast(bounds), "pattern").where(place_of(F.col("h")) < F.col("share")).groupBy("pattern", "h").agg(F.min("wanted").alias("wanted"))
    nth = F.row_number().over(W.partitionBy("pattern").orderBy("h"))
    drawn = written(below.withColumn("nth", nth).where(F.col("nth") <= F.col("wanted")).select("h", "pattern"), "drawn")  # the sample's size at most, and a row a pattern

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(x).tobytes() for x in batch.column(2).to_pylist()], pa.binary())], names=["h", "pattern", "x"])

    met = hashed.join(F.broadcast(drawn), "h").select("h", "pattern", "text").mapInArrow(each, "h long, pattern int, x binary")
    rows = met.groupBy("h", "pattern").agg(F.min("x").alias("x")).orderBy("h", "pattern").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), -1)
    drawn_codes = np.array([r["pattern"] for r in rows])
    # A rare pattern weighs more than its share, but not as much more as it is drawn.
    weights = np.sqrt(differ / wanted)[np.searchsorted(codes, drawn_codes)]
    return model, Scorer.fit(x, model.posterior(drawn_codes), weights)


def score_quality(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, quality_score, kept) of every row; the scorer (below 10 kB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(x) if shared.value else 0.0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "quality_score"])

    return _rows(docs, id_col, text_col).mapInArrow(each, "doc_id long, quality_score double").withColumn("kept", F.col("quality_score") >= threshold)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted = fit_quality(docs)
    return score_quality(docs, fitted[1] if fitted else None)
