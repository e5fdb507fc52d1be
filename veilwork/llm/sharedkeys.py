"""Which keys of a document other documents have too: the exchange beneath the n-gram join and the suffix-array dedup.

Documents are sets of 64-bit keys; a class is a set of documents that are the same for the caller, named by a 64-bit
number. Keys travel as 48-bit numbers in blocks: a task sorts the keys of a few MB of text and sends each range of keys
(a bucket) one row with differences of keys, split into byte planes, and the place of each key's class in a small table.
A bucket's task counts in how many classes each key occurs and returns the keys of two or more, again in blocks, to the
task that has a class's bucket. Per key about six bytes travel, and only keys that are shared come back.

Buckets are ranges of a hash and their number follows the number of keys. Frequent keys would outgrow a bucket: a line
that a third of all documents have is one key. They are found beforehand in a sample of bounded size (``frequent``) and
given to all tasks, which then know without asking that such a key is shared: it goes straight to its class's bucket. A
key that the sample misses takes the way of all others, so results don't depend on the sample; what is left in a bucket
of any one key is about the share of classes below which the sample can't tell. Classes count once each in a task, so
copies of a text cost nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KEY_BITS = 48
BLOCK_KEYS = 1 << 20
BUCKET_KEYS = 1_000_000
LEAST_BUCKETS = 64
#: Frequent keys: those of at least SHARE of the classes of a sample of about SAMPLE_KEYS keys, the MOST_FREQUENT at most.
SAMPLE_KEYS, SHARE, LEAST_TIMES, MOST_FREQUENT = 4_000_000, 0.002, 16, 1 << 17
#: Rows about frequent keys that a task sends reach a class's bucket through so many blocks at most at once.
BLOCKS_AT_ONCE = 1000
SENT = "bucket int, keys binary, counts binary, degrees binary, classes binary, sizes binary"
BACK = SENT


def key_of(h: np.ndarray) -> np.ndarray:
    """64-bit hashes as 48-bit keys."""
    return h >> np.uint64(64 - KEY_BITS)


def planes(sorted_keys: np.ndarray) -> bytes:
    """Ascending numbers as byte planes of their differences; planes of zeros compress to nothing."""
    gaps = np.diff(sorted_keys.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // (KEY_BITS // 8), 8), np.uint8)
    wide[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(KEY_BITS // 8, -1).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def low_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _wide(data: list[bytes]) -> np.ndarray:
    low = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, KEY_BITS // 8) for x in data])
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : KEY_BITS // 8] = low
    return wide.view("<u8").ravel()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 48-bit keys, for up to 2 ** 31 buckets."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Frequent:
    """Frequent keys (48 bits, ascending) and the log2 of about how many classes have each."""

    def __init__(self, keys: np.ndarray | None = None, levels: np.ndarray | None = None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.levels = np.zeros(0, np.uint8) if levels is None else levels

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are frequent, and their places in the table."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return hit, at[hit]


def frequent(docs: DataFrame, keys_of: Callable[[str], np.ndarray], total: int, *, text_col: str = "text", sample: int = SAMPLE_KEYS, share: float = SHARE, least: int = LEAST_TIMES, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys that many distinct texts of a sample have, ascending, and about how many texts of all have each.

    ``keys_of``: a text's distinct keys; ``total``: how many there are about in all texts. The sample is drawn by a hash of
    the text and copies in it count once. It holds about ``sample`` keys however large the corpus is.
    """
    every = max(1, -(-total // sample))
    chosen = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).distinct()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts_seen = [], 0
        for _, texts in common.text_batches(batches, text_col):
            for text in texts:
                keys = keys_of(text)
                texts_seen += len(keys) > 0
                found.append(keys)
        keys, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([texts_seen], pa.int64()), pa.array([keys.astype("<u8").tobytes()], pa.binary()), pa.array([times.astype("<u4").tobytes()], pa.binary())], ["one", "texts", "keys", "times"])

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        flat = np.concatenate([np.frombuffer(x, "<u8") for x in rows["keys"]])
        keys, place = np.unique(flat, return_inverse=True)
        times = np.bincount(place, np.concatenate([np.frombuffer(x, "<u4") for x in rows["times"]]), len(keys)).astype(np.int64)
        often = np.flatnonzero(times >= max(least, share * rows["texts"].sum()))
        often = np.sort(often[np.argsort(-times[often], kind="stable")[:most]])
        return pd.DataFrame({"keys": [keys[often].astype("<u8").tobytes()], "times": [times[often].astype("<u4").tobytes()]})

    got = chosen.mapInArrow(tally, "one int, texts long, keys binary, times binary").groupBy("one").applyInPandas(top, "keys binary, times binary").collect()
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.frombuffer(bytes(got[0]["keys"]), "<u8").astype(np.uint64), np.frombuffer(bytes(got[0]["times"]), "<u4").astype(np.int64) * every


def _deal(keys: list[np.ndarray], classes: list[int], sizes: list[int], buckets: int) -> list[tuple]:
    flat = np.concatenate(keys)
    if not len(flat):  # all keys of the block are frequent
        return []
    owner = np.repeat(np.arange(len(keys), dtype=np.uint16), [len(k) for k in keys])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    bucket = bucket_of(flat, buckets)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(edges[1:], len(flat))
    classes, sizes = np.array(classes, np.int64), np.array(sizes, np.uint32)
    rows = []
    for a, b in zip(edges, ends, strict=True):
        used, place = np.unique(owner[a:b], return_inverse=True)
        rows.append((int(bucket[a]), planes(flat[a:b]), place.astype("<u2").tobytes(), b"", classes[used].tobytes(), sizes[used].tobytes()))
    return rows


def _direct(places: list[np.ndarray], classes: list[int], sizes: list[int], table: Frequent, buckets: int, salt: int) -> list[tuple]:
    """Frequent keys by the class's bucket, which stands below 0 on this way."""
    classes, sizes, counts = np.array(classes, np.int64), np.array(sizes, np.uint32), np.array([len(p) for p in places])
    held = np.flatnonzero(counts)
    if not len(held):  # no class of the block has a frequent key
        return []
    target = classes[held] % buckets
    held = held[np.argsort(target, kind="stable")]
    target = classes[held] % buckets
    edges = np.flatnonzero(np.diff(target, prepend=-1))
    rows = []
    for a, b in zip(edges, np.append(edges[1:], len(held)), strict=True):
        own = held[a:b]
        at = np.concatenate([places[i] for i in own])
        rows.append((-1 - int(target[a]) - buckets * salt, low_bytes(table.keys[at]), counts[own].astype("<u4").tobytes(), table.levels[at].tobytes(), classes[own].tobytes(), sizes[own].tobytes()))
    return rows


def deal(docs: DataFrame, keys_of: Callable[[str], tuple[int, int, np.ndarray] | None], buckets: int, table: Frequent, salts: int, *, text_col: str = "text") -> DataFrame:
    """Blocks of keys by bucket. ``keys_of``: a text's class, its size (any number the caller wants back) and its distinct 48-bit keys, or None."""
    names = [c.split()[0] for c in SENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        total, turn = 0, 0

        def block() -> pa.RecordBatch:
            sizes, keys, places = zip(*held.values(), strict=True)
            rows = _deal(keys, list(held), sizes, buckets)
            if len(table.keys):
                rows += _direct(places, list(held), sizes, table, buckets, (turn * 0x9E3779B1 + next(iter(held))) % salts)
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

        for _, texts in common.text_batches(batches, text_col):
            for text in texts:
                found = keys_of(text)
                if found is None or found[0] in held or not len(found[2]):
                    continue
                hit, places = table.places(found[2])
                held[found[0]] = (found[1], found[2][~hit], places)
                total += len(found[2])
                if total >= BLOCK_KEYS or len(held) == 1 << 16:
                    yield block()
                    held.clear()
                    total, turn = 0, turn + 1
        if held:
            yield block()

    return docs.select(text_col).mapInArrow(run, SENT)


def _count(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of a bucket: keys that two or more classes have, by the class's bucket. Frequent keys are only put together."""
    number = int(rows["bucket"].iloc[0])
    if number < 0:
        size, owner, keys, level = _flat(rows)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        used, count = owner[starts], np.diff(np.append(starts, len(owner)))
        values = ((-1 - number) % buckets, low_bytes(keys), count.astype("<u4").tobytes(), level.tobytes(), used.tobytes(), np.array([size[c] for c in used.tolist()], np.uint32).tobytes())
        return pd.DataFrame([values], columns=[c.split()[0] for c in BACK.split(", ")])
    keys = [unplanes(x) for x in rows["keys"]]
    classes = [np.frombuffer(x, np.int64) for x in rows["classes"]]
    every, place = np.unique(np.concatenate(classes), return_inverse=True)
    size = np.zeros(len(every), np.uint32)
    size[place] = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["sizes"]])
    first = np.cumsum([0, *map(len, classes)])
    owner = np.concatenate([place[f + np.frombuffer(x, "<u2").astype(np.int64)] for f, x in zip(first, rows["counts"], strict=False)])
    flat = np.concatenate(keys)
    del keys
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    distinct = flat[fresh]
    pair = np.sort((np.cumsum(fresh) - 1).astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
    pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(pair) else pair  # a class counts once a key
    inverse, owner = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
    degree = np.bincount(inverse, minlength=len(distinct))
    shared = degree[inverse] > 1
    inverse, owner = inverse[shared], owner[shared]
    if not len(owner):
        return pd.DataFrame({c.split()[0]: [] for c in BACK.split(", ")})
    by_target = np.argsort(every % buckets, kind="stable")  # classes in the order in which they go back
    turn = np.empty(len(every), np.int64)
    turn[by_target] = np.arange(len(every))
    back = np.sort(turn[owner].astype(np.uint64) << np.uint64(32) | inverse.astype(np.uint64))
    inverse, owner = (back & np.uint64(0xFFFFFFFF)).astype(np.int64), by_target[(back >> np.uint64(32)).astype(np.int64)]
    target = every[owner] % buckets
    edges = np.flatnonzero(np.diff(target, prepend=-1))
    out: dict[str, list] = {c.split()[0]: [] for c in BACK.split(", ")}
    for a, b in zip(edges, np.append(edges[1:], len(target)), strict=True):
        starts = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
        used, count = owner[a:b][starts], np.diff(np.append(starts, b - a))
        level = np.minimum(np.log2(degree[inverse[a:b]]).astype(np.uint8), 255)
        for name, value in (("bucket", int(target[a])), ("keys", low_bytes(distinct[inverse[a:b]])), ("counts", count.astype("<u4").tobytes()), ("degrees", level.tobytes()), ("classes", every[used].tobytes()), ("sizes", size[used].tobytes())):
            out[name].append(value)
    return pd.DataFrame(out)


def _flat(rows: pd.DataFrame) -> tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes by class; and class, key and level of each pair of a class and a key, each pair once, in order."""
    classes = np.concatenate([np.frombuffer(x, np.int64) for x in rows["classes"]])
    sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["sizes"]])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]])
    level = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["degrees"]])
    keys = _wide(list(rows["keys"]))
    owner = np.repeat(classes, counts)
    order = np.lexsort((keys, owner))
    owner, keys, level = owner[order], keys[order], level[order]
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(owner) else np.zeros(0, bool)
    return dict(zip(classes.tolist(), sizes.tolist(), strict=True)), owner[fresh], keys[fresh], level[fresh]


def gather(rows: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a bucket of classes: each class, its size, its shared keys and the levels (log2) of how many classes have them."""
    size, owner, keys, level = _flat(rows)
    edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
    for a, b in zip(edges, np.append(edges[1:], len(owner)), strict=True):
        yield int(owner[a]), size[int(owner[a])], keys[a:b], level[a:b]


def buckets_for(keys: int) -> int:
    return int(max(LEAST_BUCKETS, -(-keys // BUCKET_KEYS)))


def shared(docs: DataFrame, keys_of: Callable, keys: int, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, text_col: str = "text", table: Frequent | None = None) -> DataFrame:
    """What ``each`` makes of every bucket of classes (see ``gather``). ``keys``: how many there are about in all."""
    buckets, table = buckets_for(keys), table or Frequent()
    salts = max(1, keys // (BLOCK_KEYS * BLOCKS_AT_ONCE))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return _count(rows, buckets)

    return deal(docs, keys_of, buckets, table, salts, text_col=text_col).groupBy("bucket").applyInPandas(count, BACK).groupBy("bucket").applyInPandas(each, schema)
