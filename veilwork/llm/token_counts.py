"""Token counts (operator 1): exact counts at every prefix, from a dynamic program over prefixes.

``token_counts`` answers budgets named beforehand. ``prefix_table`` keeps the count at every prefix, a byte or so a
character, to be written once; ``fit_within`` answers any later budget from the table alone, without the texts.

Null text counts as empty (0 tokens, 0 bytes). Every row gives one row, repeated rows too; an empty table gives none. Only
the id and text columns are read, whatever others are named; an id column named like a column of the result is an error.
No shuffle: each task reads its rows, a batch of a few MB at a time. A text of any length is counted whole; with prefixes
a task holds a number for each of its characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common, wordbpe

LIMIT = 2048


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", budgets: Iterable[int] = (), prefixes: bool = False, path: str | None = None) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_chars``, ``n_tokens``; for each budget ``b`` ``fit_<b>``, the length in
    code points of its longest prefix of at most ``b`` tokens; with ``prefixes`` the array ``prefix_counts`` with the count
    at each prefix, from 0 code points to all. ``path``: the vocabulary file, at the same place on every worker.
    """
    budgets = list(budgets)
    if id_col in ("n_bytes", "n_chars", "n_tokens", "prefix_counts", *(f"fit_{b}" for b in budgets)):
        raise ValueError(f"{id_col} is a column of the result")
    source = docs.select(id_col, text_col)
    fields = [T.StructField(id_col, source.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_chars", "n_tokens"))]
    fields += [T.StructField(f"fit_{b}", T.LongType()) for b in budgets] + [T.StructField("prefix_counts", T.ArrayType(T.IntegerType()))] * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path or vocabulary())
        for part, texts in common.text_batches(batches, text_col):
            rows, tables = [], []
            for text in texts:
                found = bpe.count(text)
                rows.append((len(text.encode("utf-8", "surrogatepass")), len(text), found.total, *(found.longest_within(b) for b in budgets)))
                if prefixes:
                    tables.append(found.counts())
            columns = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
            if prefixes:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def steps_of(counts: np.ndarray) -> bytes:
    """Differences between the counts at neighbouring prefixes, a byte each; four bytes each where one needs them."""
    steps = np.diff(counts.astype(np.int64))
    narrow = not len(steps) or -128 <= steps.min() and steps.max() <= 127
    return steps.astype("<i1" if narrow else "<i4").tobytes()


def counts_of(steps: bytes, n_chars: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.frombuffer(steps, "<i1" if len(steps) == n_chars else "<i4"), dtype=np.int64)))


def prefix_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, ``n_chars``, ``n_tokens`` and ``steps``, from which the count at each prefix follows."""
    if id_col in ("n_chars", "n_tokens", "steps"):
        raise ValueError(f"{id_col} is a column of the result")
    source = docs.select(id_col, text_col)
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("steps", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path or vocabulary())
        for part, texts in common.text_batches(batches, text_col):
            counts = [np.asarray(bpe.count(t).counts()) for t in texts]
            columns = [pa.array([len(c) - 1 for c in counts], pa.int64()), pa.array([int(c[-1]) for c in counts], pa.int64()), pa.array(map(steps_of, counts), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema.names)

    return source.mapInArrow(run, schema)


def fit_within(table: DataFrame, budgets: Iterable[int], *, id_col: str = "doc_id") -> DataFrame:
    """Of a prefix table, one row per document: id, and for each budget ``b`` ``fit_<b>``, the length in code points of its
    longest prefix of at most ``b`` tokens, which is -1 for budgets below 0."""
    budgets = list(budgets)
    source = table.select(id_col, "n_chars", "steps")
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), *(T.StructField(f"fit_{b}", T.LongType()) for b in budgets)])

    def longest(counts: np.ndarray, budget: int) -> int:
        within = np.flatnonzero(counts <= budget)
        return int(within[-1]) if len(within) else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[longest(counts, b) for b in budgets] for counts in map(counts_of, batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(budgets)))], schema.names)

    return source.mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(common.documents(spark, sf_dir), budgets=[LIMIT])
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {LIMIT} AS over_limit", "n_chars", f"fit_{LIMIT} AS n_chars_within_limit")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
