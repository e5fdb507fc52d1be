"""SentencePiece encoding and decoding (operator 7): segmentations sampled from the piece lattice, and lossless decoding.

All ways to write a text with the vocabulary's pieces form a lattice. Each piece has the weight ``(2 + rank) ** -alpha``,
and a segmentation is drawn with probability in proportion to the product of its weights: forward sums are filtered from
left to right, then pieces are sampled backwards from the end. The draws come from a counter-based generator seeded by the
row's key, so a row gets the same segmentation on any machine, in any partition and however often it is computed.

Pieces never cross the border before a run of spaces or around a line break, so the lattice falls apart into chunks there.
The distinct chunks of a batch are filtered together, offset by offset, and all its chunks are sampled together.

A space is the piece symbol U+2581; that symbol itself, and characters no piece has, are written as bytes. Nothing is
normalised, so decoding gives back the exact text. Null and empty text have no pieces. A null key seeds as 0, rows with
equal keys and texts are encoded alike. An empty table gives no rows. Only the id and text columns are read, whatever
others are named; an id column named like a column of the result is an error. A text of any length is encoded whole; a
chunk without spaces takes time and memory in proportion to its length, some ten numbers a character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngram_join import scramble
from .token_counts import vocabulary

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = re.compile(f"\n|{SPACE}| *[^ \n{SPACE}]+| +")
ALPHA = 0.5
LITERAL = 1 << 20 | 1 << 16  # stands for U+2581 in a text: beyond all characters, so that no piece has it
PART_BYTES = 2 << 20  # of text whose lattices a task holds at once
LONG = 60  # offsets after which sums are brought back into range


class _Trie:
    """The pieces as a trie whose edges lie in one hash table, so that many places of a text are followed at once."""

    def __init__(self, pieces: dict[str, int]):
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for piece, number in pieces.items():
            at = 0
            for c in piece:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = number
        self.bits = max(4, (4 * len(nodes)).bit_length())
        keys = np.fromiter((n << 21 | c for n, c in nodes), np.int64, len(nodes))
        self.keys, self.to = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        for key, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), nodes.values(), strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.to[slot] = key, node
        self.piece = np.full(len(nodes) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes after one more character; -1 where there is none."""
        key = node.astype(np.int64) << 21 | char
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.to[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        while len(open_):
            slot[open_] += 1
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class Pieces:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        log_weight: dict[str, float] = {}
        ids: dict[str, int] = {}
        size = model.get_piece_size()  # some pieces have scores far below any rank; they count as the last
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses a chunk's border")
                log_weight[piece], ids[piece] = -alpha * math.log(2 + min(max(0.0, -model.get_score(i)), size)), i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.trie = _Trie(ids)
        self.longest = max(map(len, ids))
        # all ways to write a prefix cover the same characters, so each may be given a factor: the inverse of its own weight
        # alone. Sums then stay at 1 or more, and far from the largest double for LONG characters.
        self.weight = np.ones(len(self.bytes_of))
        for piece, w in log_weight.items():
            alone = sum(log_weight.get(c, -alpha * math.log(2 + len(self.bytes_of)) * len(c.encode())) for c in piece)
            self.weight[ids[piece]] = math.exp(w - alone)

    def _arcs(self, chars: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arcs of chunks laid out by offset: ``first[o]`` is where the o-th characters of the ``count[o]`` chunks that
        have one begin, chunks being in descending order of length. Places of ends are laid out likewise, one offset later.

        Returned: for each end where its arcs begin, and of each arc the place where it starts, its id and weight.
        """
        chunks = int(count[0])
        ends = len(chars)  # places from 1 on; those at offset 0 are ``chunks`` many and come before
        offset = np.repeat(np.arange(len(count)), count)
        chunk = np.arange(ends) - first[offset]
        node, at = np.zeros(ends, np.int32), np.arange(ends)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            if size > 1:  # on to the next character, where the chunk has one
                last = offset[at] + size - 1
                inside = last < len(count)
                at, node, last = at[inside], node[inside], last[inside]
                inside = chunk[at] < count[last]
                at, node, last = at[inside], node[inside], last[inside]
                place = first[last] + chunk[at]
            else:
                place = at
            node = self.trie.step(node, chars[place])
            piece = np.where(node >= 0, self.trie.piece[node], -1)
            if size == 1:
                piece = np.where(piece >= 0, piece, -2)  # a character that no piece has alone
            hit = piece != -1
            found.append((place[hit], at[hit], piece[hit]))
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
        number = np.zeros(ends + 1, np.int64)
        for place, _, _ in found:
            number[place + 1] += 1
        begin = np.cumsum(number)
        source, ids = np.zeros(int(begin[-1]), np.int64), np.zeros(int(begin[-1]), np.int32)
        filled = begin[:-1].copy()
        for place, at, piece in found:
            slot = filled[place]
            # the place before character ``at``: the end of the one before, or the chunk's start
            source[slot] = np.where(offset[at] > 0, chunks + first[np.maximum(offset[at] - 1, 0)] + chunk[at], chunk[at])
            ids[slot] = np.where(piece == -2, -1 - chars[at], piece)
            filled[place] += 1
        return begin, source, ids, np.where(ids >= 0, self.weight[np.maximum(ids, 0)], 1.0)

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """A sampled segmentation of each text, as ids."""
        parts = [CHUNK.findall(t) for t in texts]
        known: dict[str, int] = {}
        which = np.array([known.setdefault(c, len(known)) for p in parts for c in p], np.int64)
        per_text = np.array([len(p) for p in parts], np.int64)
        opening = np.cumsum(per_text) - per_text
        with np.errstate(over="ignore"):
            seed = scramble(np.array([k & (1 << 64) - 1 for k in keys], np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
            place = (np.arange(len(which)) - np.repeat(opening, per_text)).astype(np.uint64)
            state = scramble(np.repeat(seed, per_text) + place * np.uint64(0xD1B54A32D192ED03))
        out = [np.zeros(0, np.int32)] * len(texts)
        if len(which):
            ids, count = self._sample(list(known), which, state)
            bounds = np.concatenate(([0], np.cumsum(count)))[np.append(opening, len(which))]
            out = [self._spelled(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def _sample(self, distinct: list[str], which: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order and how many each has; ``which``: the place of each chunk among the distinct ones."""
        size = np.array([len(c) for c in distinct], np.int64)
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        most = int(size.max())
        count = np.array([np.searchsorted(-size[order], -o, side="left") for o in range(most)], np.int64)  # chunks longer than o
        first = np.cumsum(count) - count
        # characters by offset: a space is the piece symbol, the symbol itself is beyond all characters, so that no piece has it
        flat = np.frombuffer("".join(distinct).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        flat = np.where(flat == 32, ord(SPACE), np.where(flat == ord(SPACE), LITERAL, flat))
        starts = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(distinct)), size)
        offset = np.arange(len(flat)) - starts[owner]
        chars = np.empty(len(flat), np.int64)
        chars[first[offset] + rank[owner]] = flat
        begin, source, ids, weight = self._arcs(chars, first, count)
        # forward sums, one offset after another
        chunks = len(distinct)
        total = np.ones(chunks + len(chars))
        share = np.empty(len(source))
        for o in range(most):
            a, b = first[o], first[o] + count[o]
            lo, hi = begin[a], begin[b]
            share[lo:hi] = total[source[lo:hi]] * weight[lo:hi]
            sums = total[chunks + a : chunks + b] = np.add.reduceat(share[lo:hi], begin[a:b] - lo)
            share[lo:hi] /= np.repeat(sums, np.diff(begin[a : b + 1]))
            if o % LONG == LONG - 1:  # of very long chunks, sums near here are brought back into range; only their ratios count
                self._rescale(total, chunks, first, count, o)
        summed = np.cumsum(share)
        summed -= np.repeat(summed[begin[:-1]] - share[begin[:-1]], np.diff(begin))
        # backward samples of all chunks at once
        at = np.where(size[which] > 0, chunks + first[size[which] - 1] + rank[which], 0)
        active, steps = np.arange(len(which)), []
        while len(active):
            with np.errstate(over="ignore"):
                draw = (scramble(state[active] + np.uint64(len(steps)) * np.uint64(0xABC98388FB8FAC03)) >> np.uint64(12)).astype(float) / (1 << 52)
            end = at[active] - chunks
            arc, last = begin[end], begin[end + 1] - 1
            going = np.flatnonzero((summed[arc] <= draw) & (arc < last))
            while len(going):
                arc[going] += 1
                going = going[(summed[arc[going]] <= draw[going]) & (arc[going] < last[going])]
            steps.append((active, ids[arc]))
            at[active] = source[arc]
            active = active[source[arc] >= chunks]
        number = np.zeros(len(which), np.int64)
        for some, _ in steps:
            number[some] += 1
        ends = np.cumsum(number)
        out = np.zeros(int(ends[-1]), np.int32)
        for k, (some, chosen) in enumerate(steps):
            out[ends[some] - 1 - k] = chosen
        return out, number

    def _rescale(self, total: np.ndarray, chunks: int, first: np.ndarray, count: np.ndarray, o: int) -> None:
        """Divides a chunk's last sums, as far as a piece may reach back, by its newest one."""
        if o + 1 >= len(count) or not count[o + 1]:
            return
        n = int(count[o + 1])
        newest = total[chunks + first[o] : chunks + first[o] + n].copy()
        for back in range(min(self.longest, o + 1)):
            a = chunks + first[o - back]
            total[a : a + n] /= newest

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """Characters that no piece has as their bytes."""
        if not len(ids) or ids.min() >= 0:
            return ids
        ids = ids.copy()
        wide: dict[int, tuple[int, ...]] = {}
        for i in np.unique(ids[ids < 0]).tolist():
            raw = (SPACE if -1 - i == LITERAL else chr(-1 - i)).encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                ids[ids == i] = self.byte_id[raw[0]]
            else:
                wide[i] = tuple(self.byte_id[b] for b in raw)
        return np.array([j for i in ids.tolist() for j in wide.get(i, (i,))], np.int32) if wide else ids

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def load(path: str, alpha: float = ALPHA) -> Pieces:
    """One instance in each Python process."""
    return Pieces(path, alpha)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, path: str | None = None) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``ids``, and ``lossless``: that decoding the ids gives the text."""
    if id_col in ("n_bytes", "ids", "lossless", "seed"):
        raise ValueError(f"{id_col} is a column of the result")
    source = docs.select(id_col, text_col)
    seeded = source.withColumn("seed", F.when(F.col(id_col).isNull(), 0).otherwise(F.xxhash64(id_col)).cast("long"))
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path or vocabulary(MODEL), alpha)
        for part, texts in common.text_batches(batches, text_col, PART_BYTES):
            ids = pieces.encode(texts, part.column(2).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            same = [pieces.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), lists, pa.array(same, pa.bool_())], schema.names)

    return seeded.mapInArrow(run, schema)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row: id and ``text``. Null ids give null."""
    source = encoded.select(id_col, ids_col)
    schema = T.StructType([T.StructField(id_col, source.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path or vocabulary(MODEL))
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return source.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), "lossless", "ids")


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
