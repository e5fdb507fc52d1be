"""Toxicity (operator 2): a linear classifier that swapping identity terms must not move.

Features are the distinct words of a text. Of at most ``MOST_LABELLED`` labelled rows (taken in the order of a hash, so
evenly) the executors keep the word hashes of the text and of its counterfactual: the same text with each identity term
replaced by the next of its kind. They count in how many texts of each label a word occurs, and the ``MOST_WORDS`` words
that tell the labels apart best, by the z of their log-odds, are the vocabulary, with all identity terms. To the driver
come, of each row, its places in the vocabulary or, where that is shorter, one bit a word: however long the texts are, no
more than 2.5 KB a side and row. There logistic regression is fitted with an L2 penalty and ``SWAP`` times the mean squared
difference between the log-odds of a text and of its counterfactual, so that the weights of terms within a kind are drawn
together and a neutral mention of a group tells nothing. All documents are then scored in one pass without a shuffle; the
weights are broadcast.

Null and empty texts get the score of a text without known words. Without labels of both kinds all scores are the share
of toxic labels, or 0; so they are with an empty table of documents or labels. Null labels and ids are not learned from.
Repeated rows are scored each. Only the id and text columns are read, whatever others are named; an id column named
``score`` is an error. A text of any length is read whole; a task holds its distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MOST_LABELLED = 10_000
MOST_WORDS = 20_000
SWAP = 1.0
LEAST_Z = 3.0
L2 = 1e-4

#: Kinds of identity terms; a term is swapped for the next of its kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("she", "he"), ("her", "his"), ("mother", "father"), ("daughter", "son"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender", "nonbinary"), ("homosexual", "heterosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"), ("african", "european", "american", "mexican", "chinese", "indian", "turkish"),
    ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"), ("old", "young", "elderly"), ("disabled", "blind", "deaf", "autistic"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétien", "musulman", "juif"), ("frauen", "männer"), ("frau", "mann"), ("christ", "muslim", "jude"), ("mujeres", "hombres"), ("mujer", "hombre"), ("cristiano", "musulmán", "judío"),
)
SWAPS = {term: kind[(i + 1) % len(kind)] for kind in IDENTITIES for i, term in enumerate(kind)}
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_of(token: str) -> str:
    return EDGE.sub("", token)


def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


def words_of(text: str) -> set[str]:
    return set(map(word_of, set(text.lower().split()))) - {""}


def features(docs: DataFrame, *, text_col: str, label_col: str) -> DataFrame:
    """(label, word hashes of the text, word hashes of its counterfactual) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_batches(batches, text_col):
            own = [words_of(t) for t in texts]
            swapped = [{SWAPS.get(w, w) for w in ws} for ws in own]
            hashed = [pa.array([sorted(map(hash_of, ws)) for ws in side], pa.list_(pa.int64())) for side in (own, swapped)]
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), *hashed], ["label", "words", "swapped"])

    return docs.select(text_col, F.col(label_col).cast("int").alias("label")).mapInArrow(run, "label int, words array<bigint>, swapped array<bigint>")


class Model:
    """Weights by word hash and the log-odds of a text without known words."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def score(self, hits: set[int]) -> float:
        z = self.bias + sum(self.weights[i] for i in hits)
        return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


class _Csr:
    """Rows of known words, as places in the vocabulary."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.n, self.size = len(rows), size
        self.at = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(r) for r in rows])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.at], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values[self.row], self.size)


def packed(places: np.ndarray, size: int) -> bytes:
    """Places below ``size``, or one bit each where that is shorter; the first byte says which."""
    if 4 * len(places) <= size // 8:
        return b"\0" + places.astype("<i4").tobytes()
    bits = np.zeros(size, bool)
    bits[places] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<i4", offset=1) if data[:1] == b"\0" else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=size)).astype(np.int32)


def vocabulary(rows: DataFrame, n: int, positive: int, most: int) -> np.ndarray:
    """Hashes, ascending, of the words of ``features`` that tell the labels apart, and of identity terms that occur."""
    counted = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("hits")).where("df >= 3")
    a, b = F.col("hits") + 0.5, F.col("df") - F.col("hits") + 0.5
    c, d = positive - F.col("hits") + 0.5, n - positive - (F.col("df") - F.col("hits")) + 0.5
    z = F.abs((F.log(a) + F.log(d) - F.log(b) - F.log(c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    rated = common.cut(counted.select("word", z.alias("z")))
    best = rated.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(most).select("word")
    terms = rated.where(F.col("word").isin([hash_of(w) for w in SWAPS])).select("word")
    return np.unique(np.array([r[0] for r in best.union(terms).collect()], np.int64))


def placed(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """(label, own, swapped, differ): both sides' places in the vocabulary, packed, and whether they were different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known(hashes: list[int]) -> np.ndarray:
            x = np.array(hashes, np.int64)
            at = np.minimum(np.searchsorted(words, x), max(0, len(words) - 1))
            return at[words[at] == x] if len(words) else at[:0]

        for batch in batches:
            own, swapped = (batch.column(c).to_pylist() for c in ("words", "swapped"))
            sides = [pa.array([packed(known(x), len(words)) for x in side], pa.binary()) for side in (own, swapped)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *sides, pa.array([x != y for x, y in zip(own, swapped, strict=True)], pa.bool_())], ["label", "own", "swapped", "differ"])

    return rows.mapInArrow(run, "label int, own binary, swapped binary, differ boolean")


def constant(n: int, positive: int) -> Model:
    share = positive / n if n else 0.0
    return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))


def loss(label: np.ndarray, x: _Csr, y: _Csr, differ: np.ndarray, weights: np.ndarray, bias: float, *, swap: float = SWAP, l2: float = L2) -> float:
    """What ``fit`` makes small: balanced log loss, an L2 penalty, and the mean squared change under swapped terms."""
    z, balance = x.dot(weights) + bias, _balance(label)
    change = (x.dot(weights) - y.dot(weights))[differ]
    return float(balance @ (np.logaddexp(0, z) - label * z) + l2 / 2 * weights @ weights + swap * (change @ change) / max(1, differ.sum()))


def _balance(label: np.ndarray) -> np.ndarray:
    positive = label.sum()
    out = np.where(label == 1, np.sqrt((len(label) - positive) / positive), 1.0)
    return out / out.sum()


def fit(label: np.ndarray, x: _Csr, y: _Csr, differ: np.ndarray, words: np.ndarray, *, swap: float = SWAP, l2: float = L2, steps: int = 400) -> Model:
    """Gradient descent (Adam) on the weights of ``words``. ``x`` and ``y``: the texts and their counterfactuals."""
    n, positive = len(label), float(label.sum())
    balance, weights, bias = _balance(label), np.zeros(len(words)), float(np.log(positive / (n - positive)))
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        z_own = x.dot(weights)
        error = balance * (1 / (1 + np.exp(-np.clip(z_own + bias, -60, 60))) - label)
        moved = np.where(differ, z_own - y.dot(weights), 0.0) * (2 * swap / max(1, differ.sum()))
        gradient = np.append(x.back(error) + l2 * weights + x.back(moved) - y.back(moved), error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Model(words, weights, bias)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED, most_words: int = MOST_WORDS, swap: float = SWAP) -> Model:
    rated = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    taken = rated.orderBy(F.xxhash64(id_col), id_col).limit(most)
    chosen = docs.select(id_col, text_col).join(F.broadcast(taken), id_col)  # at most ``most`` rows of two numbers
    chosen = chosen.groupBy(id_col).agg(F.max(text_col).alias(text_col), F.max("label").alias("label"))  # one row a document, however often it occurs
    rows = common.cut(features(chosen, text_col=text_col, label_col="label"))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if positive in (0, n):
        return constant(n, positive)
    words = vocabulary(rows, n, positive, most_words)
    got = placed(rows, words).toArrow()
    own, swapped = ([x.as_buffer().to_pybytes() for x in got.column(c)] for c in ("own", "swapped"))
    label, differ = got.column("label").to_numpy(), np.array(got.column("differ").to_pylist(), bool)
    order = sorted(range(n), key=lambda i: (own[i], swapped[i], label[i]))  # the same sums whatever order rows come in
    x, y = (_Csr([unpacked(side[i], len(words)) for i in order], len(words)) for side in (own, swapped))
    return fit(label[order].astype(float), x, y, differ[order], words, swap=swap)


class _Places(dict):
    """Tokens as places in the model's vocabulary; -1 for unknown words."""

    def __init__(self, words: np.ndarray):
        self.place = {int(w): i for i, w in enumerate(words)}

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[token] = found = self.place.get(hash_of(word_of(token)), -1)
        return found


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``score``."""
    if id_col == "score":
        raise ValueError("score is a column of the result")
    source = docs.select(id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(held.value.words)
        for part, texts in common.text_batches(batches, text_col):
            scores = [float(held.value.score(set(map(places.__getitem__, set(t.lower().split()))) - {-1})) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], schema.names)

    return source.mapInArrow(run, schema)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, common.labels(spark, sf_dir).where(~_held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
