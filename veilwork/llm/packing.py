"""Packing (operator 4): cost-balanced filling of training sequences.

A document's tokens are cut into pieces of at most a sequence. A piece of ``n`` tokens is estimated to cost
``linear * n + quadratic * n * n`` (attention is masked to the piece). Within a block of documents, whole sequences come
first; the remainders go, in descending order of cost, each to the sequence of lowest cost that has room for all of it. If
none of the block has, it is cut: the cheapest takes what it has room for, and the rest goes on in the same way. Blocks are bounded, so a
task holds a block of tokens and no more; what fills no whole sequence is carried to the next block. At a partition's
end the rest, under one sequence, is laid out in sequences whose lengths are powers of two, which need no padding.

There is no shuffle and nothing is gathered: the plan is one scan and one Arrow stage, whatever the size. Sequence ids
are the partition's number and a running number; a task that is run again gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common, wordbpe
from .token_counts import vocabulary

CAPACITY = 2048
END = np.array([1], "<u4").tobytes()
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK = 1 << 20  # tokens


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def assign(sizes: list[int], rooms: list[int], *, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """For each sequence, with room ``rooms[i]``, its pieces (item, start in the item, length); the rooms hold the sizes exactly."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in rooms]
    left, spent = np.array(rooms, np.int64), np.zeros(len(rooms))
    heap = [(0.0, i) for i in range(len(rooms)) if rooms[i]]
    heapq.heapify(heap)
    for item in sorted(range(len(sizes)), key=lambda i: (-cost(sizes[i], linear, quadratic), i)):
        at, rest = 0, sizes[item]
        while rest:
            while heap[0][0] != spent[heap[0][1]] or not left[heap[0][1]]:  # it was given more since
                heapq.heappop(heap)
            i = heap[0][1]
            if left[i] < rest:  # the cheapest that has room, or else it is cut and the cheapest of all takes what it can
                roomy = np.flatnonzero(left >= rest)
                i = int(roomy[spent[roomy].argmin()]) if len(roomy) else i
            n = min(rest, int(left[i]))
            out[i].append((item, at, n))
            left[i] -= n
            spent[i] += cost(n, linear, quadratic)
            at, rest = at + n, rest - n
            if left[i]:
                heapq.heappush(heap, (float(spent[i]), i))
    return out


def powers(n: int) -> list[int]:
    """``n`` as a sum of different powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs the documents of one partition, block by block."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, block: int = BLOCK, linear: float = LINEAR, quadratic: float = QUADRATIC):
        self.next_id, self.capacity, self.block, self.costs = first_id, capacity, block, {"linear": linear, "quadratic": quadratic}
        self.items: list[tuple[object, int, bytes, int]] = []  # id, start, tokens, the document's tokens
        self.held = 0
        self.rows: list[tuple] = []

    def _emit(self, key: object, start: int, tokens: bytes, whole: int, sequence: int, offset: int) -> None:
        self.rows.append((key, start, len(tokens) // 4, zlib.crc32(tokens), whole, sequence, offset, self.capacity))

    def add(self, key: object, tokens: bytes) -> None:
        n, step = len(tokens) // 4, self.capacity
        full = n - n % step
        for start in range(0, full, step):
            self._emit(key, start, tokens[4 * start : 4 * (start + step)], n, self.next_id, 0)
            self.next_id += 1
        if full < n:
            self.items.append((key, full, tokens[4 * full :], n))
            self.held += n - full
            if self.held >= self.block:
                self.flush()

    def flush(self, last: bool = False) -> None:
        """Fills whole sequences from what is held; the smallest remainders that fill none stay, unless it is the last call."""
        whole, rest = divmod(self.held, self.capacity)
        rooms = [self.capacity] * whole + (powers(rest) if last else [rest] * (rest > 0))
        sizes = [len(x[2]) // 4 for x in self.items]
        items, stay = self.items, []
        for i, pieces in enumerate(assign(sizes, rooms, **self.costs)):
            if not last and i >= whole:
                stay = [(items[k][0], items[k][1] + at, items[k][2][4 * at : 4 * (at + n)], items[k][3]) for k, at, n in pieces]
                continue
            offset = 0
            for k, at, n in pieces:
                self._emit(items[k][0], items[k][1] + at, items[k][2][4 * at : 4 * (at + n)], items[k][3], self.next_id, offset)
                offset += n
            self.next_id += 1
        self.items, self.held = stay, sum(len(x[2]) // 4 for x in stay)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK, linear: float = LINEAR, quadratic: float = QUADRATIC, path: str | None = None) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``capacity`` must be a power of two. A document is its ids and the closing id 1; null text is empty, so it is that id
    alone. Rows with the same or a null id are packed like any others. An empty table gives no rows.
    """
    source = docs.select(id_col, text_col)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path or vocabulary())
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, block, linear, quadratic)
        kind = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*(r[:7] for r in packer.taken()), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_col, *names])

        for part, texts in common.text_batches(batches, text_col):
            kind = part.schema.field(0).type
            for key, tokens in zip(part.column(0).to_pylist(), bpe.encode_each(texts), strict=True):
                packer.add(key, tokens + END)
            yield rows()
        if kind is not None:
            packer.flush(last=True)
            yield rows()

    return source.mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
