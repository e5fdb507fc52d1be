"""Language ID (operator 6): mixture inference from n-gram likelihoods.

Learning counts hashed letter trigrams per language over all learning rows: each task sums its rows into one table and
Spark adds the tables up, so what reaches the driver is the model, at most ``MOST_LANGUAGES`` times ``2 ** BITS`` numbers.
Inference takes a document's trigrams as draws from a mixture of the languages. Expectation-maximisation estimates the
proportions. The set of languages is chosen by penalised likelihood: the best single language, unless several explain the
document better by more than ``PENALTY * ln(trigrams)`` for each further one; those that don't earn this are taken out one
by one, the smallest share first. The prediction is the language of the largest share, the score that share.

Null text, and text without a letter, gives ``und`` and score 0. Rows with null language are not learned from. Ties go to
the first language by name. With nothing to learn from, all is ``und``. Repeated rows are counted as often as they occur.
An empty table gives no rows. Only the id, text and language columns are read, whatever others are named; an id column
named like a column of the result is an error. A text of any length is read whole; a task holds eight numbers or so for
each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 15
MOST_LANGUAGES = 256
SMOOTH = 0.2  # added to each trigram's count, as a share of a uniform table
PENALTY = 4.0
STEPS = 25
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Hashes of the letter trigrams of a text, lower-cased, with one space for each run of other characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint32)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - BITS)).astype(np.int64)


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages by name and the probability of each trigram in each, from all rows that have a language; of more than
    ``most`` languages those with the most text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for part, texts in common.text_batches(batches, text_col):
            for lang, text in zip(part.column(1).to_pylist(), texts, strict=True):
                table = tables.setdefault(lang, np.zeros(1 << BITS, np.int64))
                table += np.bincount(trigrams(text), minlength=1 << BITS)
                if len(tables) >= MOST_LANGUAGES:  # a task holds no more tables than the model
                    yield from flush(tables)
        yield from flush(tables)

    def flush(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["lang", "gram", "n"])
        tables.clear()

    rows = docs.where(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(count, "lang string, gram int, n long")
    found = common.cut(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    learned = found.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(most).select("lang")
    found = found.join(F.broadcast(learned), "lang").toPandas()  # at most ``most`` times 2 ** BITS numbers
    names = sorted(found["lang"].unique())
    counts = np.zeros((len(names), 1 << BITS))
    counts[np.searchsorted(names, found["lang"].to_numpy(str)) if names else [], found["gram"].to_numpy(int)] = found["n"].to_numpy(float)
    counts += SMOOTH * counts.sum(axis=1, keepdims=True) / (1 << BITS) / 100 + 0.01
    return names, counts / counts.sum(axis=1, keepdims=True)


def proportions(table: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Shares of the languages and the log-likelihood, by expectation-maximisation from equal shares."""
    shares, total = np.full(len(table), 1 / len(table)), counts.sum()
    for _ in range(steps):
        weighted = counts / (shares @ table)
        new = shares * (table @ weighted) / total
        done = np.abs(new - shares).max() < 1e-4
        shares = new
        if done:
            break
    return shares, float(counts @ np.log(shares @ table))


def infer(table: np.ndarray, grams: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of all languages; 0 for those not in the chosen set."""
    count = np.bincount(grams, minlength=table.shape[1])
    at = np.flatnonzero(count)
    counts, seen = count[at].astype(float), table[:, at]
    each = np.log(seen) @ counts
    best = int(np.argmax(each))
    price = penalty * np.log(len(grams) + 1)
    out = np.zeros(len(table))
    if len(table) > 1:
        chosen = np.arange(len(table))
        shares, whole = proportions(seen, counts)
        if whole - each[best] > price:
            while len(chosen) > 2:
                rest = np.delete(chosen, np.argmin(shares))
                fewer, value = proportions(seen[rest], counts)
                if whole - value > price:
                    break
                chosen, shares, whole = rest, fewer, value
            if whole - each[best] > price * (len(chosen) - 1):
                out[chosen] = shares
                return out
    out[best] = 1
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, and ``languages`` with the share of each language chosen."""
    if id_col in ("lang_pred", "score", "languages"):
        raise ValueError(f"{id_col} is a column of the result")
    source = docs.select(id_col, text_col)
    names, table = model
    held = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = held.value.astype(float)
        for part, texts in common.text_batches(batches, text_col):
            best, scores, sets = [], [], []
            for text in texts:
                grams = trigrams(text) if names else ()
                if not len(grams):
                    best.append(UNKNOWN), scores.append(0.0), sets.append([])
                    continue
                shares = infer(probabilities, grams, penalty)
                top = int(np.argmax(shares))
                best.append(names[top]), scores.append(min(1.0, float(shares[top])))
                sets.append([(names[k], float(shares[k])) for k in np.flatnonzero(shares)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], schema.names)

    return source.mapInArrow(run, schema)


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = identify(docs, learn(docs.where(~_held_out(F.col("doc_id")))))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
