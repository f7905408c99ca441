"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read one character at a time. The search keeps a window of the
places from which a piece may still grow (at most as many as the longest piece
has characters), each with its best score and a link to the ids before it. Where
no piece grows on, there is one path, and its ids are final. Elsewhere the links
of all survivors are followed back, at the latest when the window has moved by
its whole width: the ids up to the boundary that they all pass are final. Final
ids are committed and the links before them are cut, so what is held is the
window and the part that is still undecided, however long the text. (A run of
one letter can be undecided to its end, as ways that cut it at other places
never meet; there the held part is the run.)

No piece goes on from another character into the space mark, so all paths
converge where a space follows a word (this is verified when the vocabulary is
loaded). The ids of a stretch between two such boundaries depend on nothing
else, and those of short stretches are remembered in a table of bounded size,
which saves searching for a word that has just been searched for.

A character without a piece becomes its UTF-8 bytes, and so does a literal
space mark (U+2581), which makes decoding an exact inverse. Of paths with the
same score, the one whose last piece is longest wins.

Piece scores of a unigram model are log probabilities and serve as they are. A
merge model lists ranks instead, which do not add up; there, a piece weighs
``-log(ZIPF_OFFSET + rank)``. The best path under such weights need not be the
segmentation that the model's own merges give (README has figures).

The model's own settings hold for what stands before a text (its dummy prefix);
a model that changes texts otherwise (a normaliser's table, white space removed
or put last) is refused, as its decoding could be no inverse.

Defined cases: a null or empty text has no ids and decodes to an empty text;
null ids decode to an empty text; equal rows stay; texts of any length are
encoded whole; an empty table gives an empty result. Only the id and the text
(or the ids) are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import bounded_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Longest stretch whose ids are remembered, and how many of them a worker keeps (twice).
SHORT, REMEMBERED = 48, 200_000
UNKNOWN_PENALTY = 10.0
#: Zipf-Mandelbrot offset that turns the rank of a piece into a log probability.
ZIPF_OFFSET = 100.0
#: Where no piece begins.
NOTHING = ({}, None, ())
#: Weights are whole multiples of 1 / UNIT.
UNIT = 1 << 20


class Vocabulary:
    """Pieces of a SentencePiece model as a trie; no piece may go from another character into the space mark."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that changes texts before it cuts them is not supported")
        self.prefix = " " if rules.add_dummy_prefix else ""
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: A node: the nodes after it by character, and the weight and id of the piece that ends with it.
        self.trie: list = [{}, None, ()]
        self.longest = 1
        self.byte_ids = [0] * 256
        self.bytes_of: list[bytes] = []
        scores = []
        size = reader.get_piece_size()
        ranked = all(reader.get_score(i).is_integer() for i in range(size))
        score = (lambda i: -math.log(ZIPF_OFFSET + i)) if ranked else reader.get_score
        weight = lambda i: float(round(score(i) * UNIT))  # noqa: E731  sums of whole numbers are exact in any order
        for i in range(size):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            if reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i):
                self.bytes_of.append(b"")
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"a piece crosses into the space mark: {piece!r}")
            self.bytes_of.append(piece.replace(MARK, " ").encode())
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, None, ()])
            node[1:] = weight(i), (i,)
            self.longest = max(self.longest, len(piece))
            scores.append(weight(i))
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY * UNIT
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def spell(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Lists of ids, each final when it is given out; joined, they are the ids of the whole text."""
        root, unknown, longest = self.trie[0], self.unknown, self.longest
        # A link: [boundary, ids, link before]; of a survivor: nodes after its piece so far, score before the piece, link.
        score, link, at, checked = 0.0, [0, (), None], 0, 0
        growing: list[tuple[dict, float, list]] = []
        for c in chars:
            at += 1
            best, ids, way, grown = -math.inf, (), link, []
            for after, before, back in growing:  # the longest first
                node = after.get(c)
                if node is not None:
                    after, weight, own = node
                    if weight is not None and before + weight > best:
                        best, ids, way = before + weight, own, back
                    if after:
                        grown.append((after, before, back))
            after, weight, own = root.get(c, NOTHING)
            if weight is None:
                weight, own = unknown, None
            if score + weight > best:
                best, ids, way = score + weight, self.spell(c) if own is None else own, link
            if after:
                grown.append((after, score, link))
            growing, score, link = grown, best, [at, ids, way]
            if not grown:
                yield _ids(link)
                link, checked = [at, (), None], at
            elif at - checked >= longest:
                checked = at
                common = _common([link, *(back for _, _, back in grown)])
                if common[2] is not None:
                    yield _ids(common)
                    common[1:] = (), None  # the way to it is let go
        yield _ids(link)

    def stretch(self, text: str) -> bytes:
        """Ids (int32) of a stretch between boundaries where all paths converge."""
        if len(text) <= SHORT:
            found = self.recent.get(text) or self.older.get(text)
            if found is not None:
                self._remember(text, found)
                return found
        if text == MARK:
            found = array("i", self.spell(MARK)).tobytes()  # a mark of the text itself is no space
        else:
            held = array("i")
            for ids in self.stream(text.replace(" ", MARK)):
                held.extend(ids)
            found = held.tobytes()
        if len(text) <= SHORT:
            self._remember(text, found)
        return found

    def _remember(self, text: str, found: bytes) -> None:
        if len(self.recent) >= REMEMBERED:
            self.older, self.recent = self.recent, {}
        self.recent[text] = found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out = []
        for hit in STRETCH.finditer(self.prefix + text):
            piece = hit[0]
            out.append(self.recent.get(piece) or self.stretch(piece))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        pieces = self.bytes_of
        text = b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


#: What lies between two boundaries where all paths converge: spaces and the word after them; a space mark by itself.
STRETCH = re.compile(f" *[^ {MARK}]+| +|{MARK}")


def _ids(link: list | None) -> list[int]:
    """The ids on the way to a link."""
    parts = []
    while link is not None:
        parts.append(link[1])
        link = link[2]
    return [i for part in reversed(parts) for i in part]


def _common(links: list[list]) -> list:
    """The last link that the ways to all of the links pass: those that lie farthest go back until they meet."""
    while True:
        far = max(x[0] for x in links)
        if all(x[0] == far for x in links):
            return links[0]  # one boundary has one link
        links = [x[2] if x[0] == far else x for x in links]


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary for each model in a worker."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row. The model file (below 1 MB) is read on the driver and broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model.value)
        for batch in batches:
            ids = [vocabulary.encode(x.as_py()) for x in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(each, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of every row; null ids decode to an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model.value)
        for batch in batches:
            texts = [vocabulary.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return bounded_batches(rows).mapInArrow(each, "doc_id long, ids array<int>, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids_sha256 of the ids joined by spaces, decoded_sha256 of the text decoded from them)."""
    done = decode(encode(table(spark, sf_dir, "documents")))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
