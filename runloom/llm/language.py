"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads texts in both directions, gives every position a distribution
over the languages, and a document the mean of those of all its positions. It is
trained in numpy by backpropagation through time on a bounded sample
(``per_language`` documents of each language, ``pieces`` stretches of each); every
position of every text is labelled. A text is cut into windows of WINDOW bytes,
whose recurrent steps run at once for all windows of a batch; each direction
begins MARGIN bytes before the window, in the text around it, so no position is
labelled from less than so much context (or the text's end) and no letter is
split where it is labelled.

The sample is drawn by a hash of id and text: those that lie below a bound that
follows from the number of different ones of each language, of which the least
are taken. Only these few are ranked, whatever the number of partitions.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text if there is nothing to learn from; a null language is not learned
from; ids may be null or repeat; equal rows stay, and are learned from once;
texts of any length are labelled whole, in batches of LANES windows; an empty
table gives an empty result. Columns other than id, text and language are not
read, and the language only to learn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.common import bounded_batches, bounded_broadcast, place_of, table, written

WINDOW = 112
#: Bytes of context by which the recurrence of each direction begins earlier than the window.
MARGIN = 16
#: Characters and bytes of a stretch that is learned from.
STRETCH = 64
HIDDEN = 8
#: Index of the padding symbol after a text's last byte; its gate keeps the state.
PAD = 256
KEEP = 30.0
#: Windows that are labelled at once, which bounds the memory of a batch.
LANES = 1024
UNDETERMINED = "und"
#: Languages whose bounds may be broadcast: under 100 bytes each.
BROADCAST_ROWS = 100_000


class Network:
    """Weights by name, each for [forward, backward]; columns of the gates are keep, reset, new."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        scale = 1 / np.sqrt(hidden)
        self.weights = {
            "input": rng.normal(0, 0.3, (2, 3 * hidden, 257)),
            "state": rng.normal(0, scale, (2, 3 * hidden, hidden)),
            "out": rng.normal(0, scale, (len(languages), 2 * hidden)),
            "bias": np.zeros((len(languages), 1)),
        }
        self.weights["input"][:, :, PAD] = 0
        self.weights["input"][:, :hidden, PAD] = KEEP

    def _steps(self, codes: np.ndarray, way: int) -> Iterator[tuple[int, np.ndarray]]:
        order = range(codes.shape[0])
        return ((t, codes[t]) for t in (order if way == 0 else reversed(order)))

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Probabilities [T, languages, lanes] for codes [T, lanes], and what the backward pass needs."""
        n, w, (steps, lanes) = self.hidden, self.weights, codes.shape
        states, tape = np.zeros((steps, 2 * n, lanes)), []
        for way in (0, 1):
            h = np.zeros((n, lanes))
            for t, c in self._steps(codes, way):
                a = w["input"][way][:, c]
                u = w["state"][way] @ h
                z = 1 / (1 + np.exp(-(a[:n] + u[:n])))
                r = 1 / (1 + np.exp(-(a[n : 2 * n] + u[n : 2 * n])))
                new = np.tanh(a[2 * n :] + r * u[2 * n :])
                tape.append((way, t, c, h, z, r, new, u[2 * n :]))
                h = z * h + (1 - z) * new
                states[t, way * n : (way + 1) * n] = h
        logits = np.matmul(w["out"], states) + w["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), [states, tape]

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of every position that is no padding, and its gradients, by backpropagation through time."""
        n, w = self.hidden, self.weights
        p, (states, tape) = self.forward(codes)
        real = (codes != PAD)[:, None, :]
        total = max(1, int(real.sum()))
        lanes = np.arange(codes.shape[1])
        loss = -np.sum(np.log(p[:, labels, lanes] + 1e-12) * real[:, 0]) / total
        d = p.copy()
        d[:, labels, lanes] -= 1
        d = d * real / total
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = np.einsum("tcl,thl->ch", d, states)
        g["bias"] = d.sum(axis=(0, 2))[:, None]
        back = np.matmul(w["out"].T, d)
        carry = np.zeros((n, codes.shape[1]))
        last = None
        for way, t, c, h, z, r, new, u in reversed(tape):
            if way != last:
                carry, last = np.zeros_like(carry), way
            dh = carry + back[t, way * n : (way + 1) * n]
            dz = dh * (h - new) * z * (1 - z)
            da = dh * (1 - z) * (1 - new * new)
            dr = da * u * r * (1 - r)
            du = np.concatenate([dz, dr, da * r])
            dx = np.concatenate([dz, dr, da])
            carry = dh * z + w["state"][way].T @ du
            g["state"][way] += du @ h.T
            np.add.at(g["input"][way].T, c, dx.T)
        g["input"][:, :, PAD] = 0
        return loss, g

    def train(self, codes: np.ndarray, labels: np.ndarray, steps: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
        """Adam over random batches of windows codes [windows, T]."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        for step in range(1, steps + 1):
            some = rng.integers(0, len(codes), batch)
            _, g = self.gradients(codes[some].T, labels[some])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.weights[k] = self.weights[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def compiled(self) -> Compiled:
        return Compiled(self)


class Compiled:
    """The trained network in single precision, laid out for labelling many windows at once."""

    def __init__(self, network: Network):
        n = network.hidden
        half = np.ones((3 * n, 1))
        half[: 2 * n] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.languages, self.hidden = network.languages, n
        self.input = [np.ascontiguousarray(x * half, dtype=np.float32) for x in network.weights["input"]]
        self.state = [np.ascontiguousarray(x * half, dtype=np.float32) for x in network.weights["state"]]
        self.out = network.weights["out"].astype(np.float32)
        self.bias = network.weights["bias"].astype(np.float32)

    def _run(self, codes: np.ndarray, way: int) -> np.ndarray:
        """States at the positions of the windows, from a margin before each in this direction."""
        n, (steps, lanes) = self.hidden, codes.shape
        states = np.empty((steps - 2 * MARGIN, n, lanes), np.float32)
        a, u, margin = np.empty((3 * n, lanes), np.float32), np.empty((3 * n, lanes), np.float32), np.empty((n, lanes), np.float32)
        h = np.zeros((n, lanes), np.float32)
        for t in range(steps - MARGIN) if way == 0 else range(steps - 1, MARGIN - 1, -1):
            np.take(self.input[way], codes[t], axis=1, out=a, mode="clip")
            np.matmul(self.state[way], h, out=u)
            gates, new, un = a[: 2 * n], a[2 * n :], u[2 * n :]
            gates += u[: 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            un *= gates[n:]
            new += un
            np.tanh(new, out=new)
            out = states[t - MARGIN] if 0 <= t - MARGIN < len(states) else margin
            np.subtract(h, new, out=out)
            out *= gates[:n]
            out += new
            h = out
        return states

    def window_sums(self, codes: np.ndarray) -> np.ndarray:
        """[windows, languages]: sums over the positions of each window (codes: windows with their margins) of their probabilities."""
        sums = np.empty((len(codes), len(self.languages)), np.float32)
        for at in range(0, len(codes), LANES):
            part = np.ascontiguousarray(codes[at : at + LANES].T)
            ahead, behind = self._run(part, 0), self._run(part, 1)
            n = self.hidden
            p = np.matmul(self.out[:, :n], ahead)
            p += np.matmul(self.out[:, n:], behind)
            p += self.bias
            np.exp(p, out=p)
            total = p.sum(axis=1)
            p *= ((part[MARGIN : len(part) - MARGIN] != PAD) / total)[:, None, :].astype(np.float32)
            sums[at : at + LANES] = p.sum(axis=0).T
        return sums


def windows_of(data: bytes, start: int = 0, end: int | None = None) -> np.ndarray:
    """The bytes of a text from start to end (whole windows, or up to its end) in rows of a window with its margins, padded beyond the text."""
    end = len(data) if end is None else min(end, len(data))
    rows = -(-(end - start) // WINDOW)
    codes = np.full(rows * WINDOW + 2 * MARGIN, PAD, np.int16)
    first, last = max(0, start - MARGIN), min(len(data), end + MARGIN)
    codes[first - start + MARGIN : last - start + MARGIN] = np.frombuffer(data, np.uint8)[first:last]
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW + 2 * MARGIN)[::WINDOW]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def label_texts(network: Compiled | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, its mean probability over all positions) of each text."""
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if network is None:
        return out
    held: list[tuple[int, np.ndarray]] = []
    sums: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}

    def flush() -> None:
        if held:
            codes = np.concatenate([x[1] for x in held])
            found = network.window_sums(codes)
            at = 0
            for i, rows in held:
                sums[i] = sums.get(i, 0.0) + found[at : at + len(rows)].sum(axis=0, dtype=np.float64)
                at += len(rows)
            held.clear()

    waiting = 0
    for i, text in enumerate(texts):
        if not has_letter(text):
            continue
        data = text.encode("utf-8", "surrogatepass")
        sizes[i] = len(data)
        for at in range(0, len(data), WINDOW * LANES):
            rows = windows_of(data, at, at + WINDOW * LANES)
            held.append((i, rows))
            waiting += len(rows)
            if waiting >= 2 * LANES:
                flush()
                waiting = 0
    flush()
    for i, total in sums.items():
        mean = total / sizes[i]
        best = int(mean.argmax())
        out[i] = (network.languages[best], float(min(1.0, max(0.0, mean[best]))))
    return out


def held_out(id_col: Column) -> Column:
    """Whether a document takes no part in learning."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int, pieces: int) -> DataFrame:
    """(lang, h, parts): per_language documents of each language, those with the least hashes of id and text, and of each
    `pieces` stretches of STRETCH characters at hashed places."""
    text = F.col(text_col).cast("string")
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(text) > 0))
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text"))
    # Twice as many as are wanted lie below a language's bound; equal rows have one hash and count once.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    shares = written(sizes.select("lang", F.when(F.col("n") > 4 * per_language, 2 * per_language / F.col("n")).otherwise(2.0).alias("share")), "shares")
    below = rows.join(bounded_broadcast(shares, BROADCAST_ROWS), "lang").where(place_of(F.col("h")) < F.col("share"))
    at = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length("text") - STRETCH, F.lit(1))) + 1
    parts = F.array(*[F.substring("text", at(k).cast("int"), F.lit(STRETCH)) for k in range(pieces)])
    drawn = below.select("lang", "h", parts.alias("parts")).groupBy("lang", "h").agg(F.min("parts").alias("parts"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return drawn.withColumn("k", nth).where(F.col("k") <= per_language).drop("k")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, pieces: int = 6, steps: int = 300) -> Compiled | None:
    """Learn from a bounded sample of docs (see sampled); its rows of under 1 kB are collected, per_language for each language."""
    sample = sampled(docs, id_col, text_col, lang_col, per_language, pieces).collect()
    sample.sort(key=lambda r: (r["lang"], r["h"]))
    languages = sorted({r["lang"] for r in sample})
    if not languages:
        return None
    codes, labels = [], []
    for r in sample:
        for part in dict.fromkeys(r["parts"]):
            data = part.encode("utf-8", "surrogatepass")[:STRETCH]
            codes.append(np.frombuffer(data.ljust(STRETCH, b"\0"), np.uint8).astype(np.int16))
            codes[-1][len(data) :] = PAD
            labels.append(languages.index(r["lang"]))
    return Network(languages).train(np.stack(codes), np.array(labels), steps).compiled()


def predict(docs: DataFrame, network: Compiled | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' (doc_id, lang_pred, score) for every row, from the text alone. The network (below 50 kB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(each, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Compiled | None, text_col: str = "text", least_score: float = 0.3) -> DataFrame:
    """The rows of docs, in its columns, whose language is known with at least so high a mean probability; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    names = docs.columns
    at = names.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label_texts(shared.value, batch.column(at).to_pylist())
            kept = batch.filter(pa.array([x != UNDETERMINED and p >= least_score for x, p in found], pa.bool_()))
            yield kept.rename_columns(names)

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # a name with a dot cannot go to Python
    return bounded_batches(plain).mapInArrow(each, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, network).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
