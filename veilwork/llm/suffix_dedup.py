"""Suffix-array dedup (operator 5): bytes that an earlier document has too, by suffix arrays of shards.

A byte goes if a string of ``length`` (50) bytes that covers it also starts in a document with a smaller id. Every such
string (a window) has an anchor: the leftmost of its 20-byte pieces with the least hash, so equal windows have equal
anchors at equal places. Anchors that only one text has rule their windows out; that is all of most texts, and nothing of
them travels but the anchors' keys (see ``sharedkeys``). What remains is sharded by anchor: for each shared anchor its
windows, which follow one another, go to the anchor's shard as one stretch of bytes.

A shard sorts the suffixes of its stretches by Larsson-Sadakane refinement (ranks by the first 8 bytes, then twice as many
in each round, sorting only groups that are not settled) and takes common prefixes by Kasai's rule, along all stretches at
once. Windows between which the common prefix is 50 or more are equal; each learns the least id of its kind. Shards are cut
at ``shard_bytes`` into parts with suffix arrays of their own, merged by binary search of each part's sorted windows.

A passage that many documents have would make its anchors' shards grow with the corpus. Frequent pieces are found
beforehand in a sample of bounded size (``sharedkeys.frequent``; results don't depend on it) and are anchors only of
windows in which all pieces are frequent. Such windows are dealt by anchor and by document to sub-shards, each with a
suffix array of its own. A sub-shard sends every distinct window once, with its least id there; the sub-shards' sorted
windows are merged by binary search, in ranges of a hash, and each sub-shard learns where another knows a lesser id.

Texts that are equal as a whole go on as one, the one with the least id; later copies of 50 bytes or more go entirely.
Texts are told apart by a 64-bit hash, and by a second one where two texts share the first.

Null text counts as empty: nothing to remove. Ids are cast to long; null ids count as larger than all others. Rows with the
same id don't make each other's bytes go. Empty tables give no rows. Other columns are not looked at, whatever their names;
an id column named like a column of the result is an error. Matches never cross documents. A text of any length is one
row; beside it a task holds some ten numbers for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sharedkeys
from .ngram_join import scramble

LENGTH = 50
PIECE = 20
SHARD_BYTES = 4 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
#: A sample of so many bytes, and how many of its texts make a piece frequent (see ``sharedkeys.frequent``).
SAMPLE_BYTES, SHARE = 8_000_000, 0.005
#: Documents of one sub-shard about, and sub-shards of an anchor at least.
SUB_CLASSES, LEAST_SALTS = 1_000_000, 4
LAST = np.uint64(1 << 63)


class Often:
    """Hashes of frequent pieces, ascending."""

    def __init__(self, hashes: np.ndarray | None = None):
        self.hashes = np.zeros(0, np.uint64) if hashes is None else hashes
        self.marks: np.ndarray | None = None

    def order(self, h: np.ndarray) -> np.ndarray:
        """Numbers that order pieces as their hashes do, but frequent ones after all others."""
        out = h >> np.uint64(1)
        if len(self.hashes):
            if self.marks is None:  # a first look that few others pass
                self.marks = np.zeros(1 << 20, bool)
                self.marks[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
            maybe = np.flatnonzero(self.marks[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            out[maybe[self.hashes[at] == h[maybe]]] |= LAST
        return out


NONE = Often()


# -- anchors ----------------------------------------------------------------------------------------------------------


def pieces(data: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The hash of the piece at each place of a text."""
    if len(data) < piece:
        return np.zeros(0, np.uint64)
    base, size, done, left = 0x9E3779B97F4A7C15 | 1, 1, None, piece
    power, h, shift = base, data.astype(np.uint64) + np.uint64(1), 0
    with np.errstate(over="ignore"):
        while True:  # polynomial hashes of pieces of 1, 2, 4, ... bytes; those of the wanted size are put together from them
            if left & size:
                if done is None:
                    done, shift = h, size
                else:
                    n = len(data) - shift - size + 1
                    done = done[:n] * np.uint64(power) + h[shift : shift + n]
                    shift += size
                left -= size
            if not left:
                break
            n = len(h) - size
            h = h[:n] * np.uint64(power) + h[size:]
            power = power * power & (1 << 64) - 1
            size *= 2
    return scramble(done)


def anchors(data: np.ndarray, length: int = LENGTH, piece: int = PIECE, often: Often = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a text its anchor's place, ascending; the hash of the piece at each place; and which are frequent."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h = pieces(data, piece)
    order = often.order(h)
    wide = length - piece + 1
    best, covered = np.arange(len(h)), 1
    while covered < wide:
        step = min(covered, wide - covered)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(order[a] <= order[b], a, b)
        covered += step
    return best, h, order >= LAST


def keys_of_places(h: np.ndarray) -> np.ndarray:
    return sharedkeys.key_of(scramble(h ^ np.uint64(0x5851F42D4C957F2D)))


def class_of(text: bytes, bits: int = 64) -> int:
    """As the built-in function xxhash64 of the text, its first bits."""
    return int(np.array([xxhash.xxh64_intdigest(text, seed=42) >> 64 - bits], np.uint64).view(np.int64)[0])


# -- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a byte string in order and the rank of each, by Larsson-Sadakane refinement."""
    n = len(s)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = s
    for size in (1, 2, 4):  # bytes that a number holds, doubled
        wide[: n + 8 - size] = wide[: n + 8 - size] << np.uint64(8 * size) | wide[size:]
    first = wide[:n]
    sa = np.argsort(first)
    ordered = first[sa]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    # a suffix's rank is the place of the last of its group; shorter ones come first since what is beyond the end counts as 0 and less
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    rank[sa] = np.repeat(ends - 1, ends - starts)
    h = 8
    open_ = np.flatnonzero(np.repeat(ends - starts > 1, ends - starts))  # places in sa that are not settled
    while len(open_):
        suffix = sa[open_]
        after = suffix + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], n - 1 - after)  # beyond the end: the shorter the less
        group = rank[suffix]
        both = group.astype(np.uint64) << np.uint64(32) | (second + n).astype(np.uint64)  # shards are far below 2 ** 31 bytes
        order = np.argsort(both)
        suffix, both = suffix[order], both[order]
        sa[open_] = suffix
        fresh = np.concatenate(([True], both[1:] != both[:-1]))
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(open_))
        rank[suffix] = np.repeat(open_[ends - 1], ends - starts)
        open_ = open_[np.repeat(ends - starts > 1, ends - starts)]
        h *= 2
    return sa, rank


def common_prefixes(s: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``sa`` the common prefix with the place before, up to ``most``.

    Kasai's rule: a suffix shares with its predecessor at least one byte less than the suffix one place to the left does
    with its own. It is followed along all stretches (``starts``, ``sizes``) at the same time.
    """
    n = len(s)
    out = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((s, np.zeros(most + 1, s.dtype)))
    shared = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        lanes = np.flatnonzero(sizes > t)
        at = starts[lanes] + t
        other = before[at]
        now = np.maximum(shared[lanes] - 1, 0)
        going = np.flatnonzero((other >= 0) & (now < most))
        now[other < 0] = 0
        while len(going):
            a, b = at[going] + now[going], other[going] + now[going]
            same = (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            going = going[same]
            now[going] += 1
            going = going[now[going] < most]
        shared[lanes] = now
        out[rank[at]] = now
    return out


def merged(known: np.ndarray, least: np.ndarray, windows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two ascending lists of windows as one, with the least id of each, by binary search of the second's windows among the
    first's; and the places at which windows were put in."""
    at = np.searchsorted(known, windows)
    found = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == windows) if len(known) else np.zeros(len(windows), bool)
    least = least.copy()
    least[at[found]] = np.minimum(least[at[found]], own[found])
    fresh = at[~found]
    return np.insert(known, fresh, windows[~found]), np.insert(least, fresh, own[~found]), fresh


def kinds(stretches: list[bytes], ids: np.ndarray, length: int = LENGTH, part_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct windows of all stretches in order, the least id of each, and for each stretch the places of its windows."""
    parts, held, first = [], 0, 0
    for i, x in enumerate(stretches):
        if i > first and held + len(x) > part_bytes:
            parts.append((first, i))
            first, held = i, 0
        held += len(x) + 1
    parts.append((first, len(stretches)))
    every, least, places = None, None, []
    for a, b in parts:
        windows, own, kind = _part(stretches[a:b], ids[a:b], length)
        if every is None:
            every, least, place = windows, own, np.arange(len(windows))
        else:
            every, least, fresh = merged(every, least, windows, own)
            for k in range(len(places)):  # places move up by the windows put before them
                places[k] = [x + np.searchsorted(fresh, x, side="right") for x in places[k]]
            place = np.searchsorted(every, windows)
        places.append([place[x] for x in kind])
    return every, least, [x for part in places for x in part]


def least_ids(stretches: list[bytes], ids: np.ndarray, length: int = LENGTH, part_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each window of each stretch the least id of the stretches in which it occurs."""
    _, least, places = kinds(stretches, ids, length, part_bytes)
    return [least[x] for x in places]


def _part(stretches: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct windows in order (bytes raised by one, as UTF-8 has no 255 and numpy drops zeros at the end), the least id
    of each, and for each stretch the places of its windows among them."""
    sizes = np.array([len(x) for x in stretches], np.int64)
    s = np.frombuffer(b"\xff".join(stretches) + b"\xff", np.uint8) + np.uint8(1)  # 255, which parts stretches, becomes 0
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    sa, rank = suffix_array(s)
    lcp = common_prefixes(s, sa, rank, starts, sizes, length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(s)) - starts[owner]
    whole = offset + length <= sizes[owner]  # suffixes that begin with a window
    group = np.cumsum(np.concatenate(([True], lcp[1:] < length))) - 1
    at = np.flatnonzero(whole[sa])
    kinds, first, inverse = np.unique(group[at], return_index=True, return_inverse=True)
    least = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, ids[owner[sa[at]]])
    windows = np.lib.stride_tricks.sliding_window_view(s, length)[sa[at[first]]] if len(kinds) else np.zeros((0, length), np.uint8)
    windows = np.ascontiguousarray(windows).view(f"S{length}").ravel()
    of = np.empty(len(s), np.int64)
    of[sa[at]] = inverse
    return windows, least, [of[a : a + max(0, n - length + 1)] for a, n in zip(starts, sizes, strict=True)]


# -- operator ---------------------------------------------------------------------------------------------------------

STRETCHES = "shard int, bytes binary, sizes binary, which binary, classes binary, ids binary, starts binary"
#: What shards say. gone: windows to remove, by home. windows: a sub-shard's, by merging task. state: what it needs to end.
GONE, WINDOWS, STATE = 0, 1, 2
SAID = "kind int, number int, origin int, classes binary, starts binary, masks binary, which binary, ids binary, windows binary, places binary, least binary"
LESSER = "number int, places binary, least binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _stretches(texts: DataFrame, shards: int, salts: int, often: Often) -> DataFrame:
    """Of each text the stretches at shared anchors, in blocks by shard; equal stretches of a block travel once. Stretches
    at frequent anchors go to sub-shards, whose numbers are below 0."""
    groups = max(1, shards // salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in common.text_batches(batches, "text"):
            by_shard: dict[int, tuple[dict[bytes, int], list[tuple[int, int, int, int]]]] = {}
            for text, shared, number, order in zip(found, part.column("keys").to_pylist(), part.column("class").to_pylist(), part.column("id").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                place, h, last_resort = anchors(np.frombuffer(raw, np.uint8), often=often)
                first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                last = np.append(first[1:], len(place)) - 1 + LENGTH
                keys, wanted = keys_of_places(h[place[first]]), np.frombuffer(shared, "<u8")
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys)
                sub = -1 - (sharedkeys.bucket_of(keys[hit], groups) * salts + number % salts)
                shard = np.where(last_resort[place[first[hit]]], sub, sharedkeys.bucket_of(keys[hit], shards)).tolist()
                for k, a, b in zip(shard, first[hit].tolist(), last[hit].tolist(), strict=True):
                    found_in = by_shard.get(k)
                    if found_in is None:
                        found_in = by_shard[k] = ({}, [])
                    table, rows = found_in
                    rows.append((table.setdefault(raw[a:b], len(table)), number, order, a))
            out: list[list] = [[] for _ in range(7)]
            for shard, (table, rows) in by_shard.items():
                which, classes, ids, starts = zip(*rows, strict=True)
                values = (shard, b"".join(table), np.array([len(x) for x in table], "<u4").tobytes(), np.array(which, "<u4").tobytes(), np.array(classes, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), np.array(starts, "<u4").tobytes())
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], _names(STRETCHES))

    return texts.mapInArrow(run, STRETCHES)


def _read(rows: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's distinct stretches; and of each occurrence which it is, its text's class and id and its place there."""
    table: dict[bytes, int] = {}
    which, classes, ids, starts = [], [], [], []
    for row in rows.itertuples(index=False):
        ends = np.cumsum(np.frombuffer(row.sizes, "<u4").astype(np.int64)).tolist()
        own = np.array([table.setdefault(row.bytes[a:b], len(table)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
        which.append(own[np.frombuffer(row.which, "<u4")])
        classes.append(np.frombuffer(row.classes, "<i8"))
        ids.append(np.frombuffer(row.ids, "<i8"))
        starts.append(np.frombuffer(row.starts, "<u4"))
    return list(table), *map(np.concatenate, (which, classes, ids, starts))


def _gone(least: list[np.ndarray], which: np.ndarray, classes: np.ndarray, ids: np.ndarray, starts: np.ndarray, homes: int) -> pd.DataFrame:
    """For each occurrence of a stretch which of its windows an earlier text has, as bits, by the text's home."""
    wide = LENGTH - PIECE + 1
    padded = np.full((len(least), wide), np.iinfo(np.int64).max)
    for i, x in enumerate(least):
        padded[i, : len(x)] = x
    masks = np.zeros(len(which), np.uint32)
    for t in range(wide):
        masks |= (padded[which, t] < ids).astype(np.uint32) << np.uint32(t)
    gone = masks > 0
    classes, starts, masks = classes[gone], starts[gone], masks[gone]
    home = classes % homes
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1))
    out = [(GONE, int(home[order[a]]), classes[order[a:b]].tobytes(), starts[order[a:b]].tobytes(), masks[order[a:b]].tobytes()) for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True)]
    return pd.DataFrame(out, columns=["kind", "number", "classes", "starts", "masks"]).reindex(columns=_names(SAID)).assign(origin=0)


def _bytes_hash(windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = scramble(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)
        return scramble(windows.view(np.uint8).reshape(-1, length).astype(np.uint64) @ factors) if len(windows) else np.zeros(0, np.uint64)


def _judge(rows: pd.DataFrame, homes: int, merges: int, part_bytes: int) -> pd.DataFrame:
    """Of a shard what is to go; of a sub-shard its distinct windows, for the merging tasks, and its state."""
    number = int(rows["shard"].iloc[0])
    table, which, classes, ids, starts = _read(rows)
    first = np.full(len(table), np.iinfo(np.int64).max)
    np.minimum.at(first, which, ids)
    windows, least, places = kinds(table, first, LENGTH, part_bytes)
    if number >= 0:
        return _gone([least[x] for x in places], which, classes, ids, starts, homes)
    said: list[dict] = [{"kind": STATE, "number": number, "classes": classes.tobytes(), "starts": starts.tobytes(), "which": which.astype("<u4").tobytes(), "ids": ids.tobytes(), "windows": np.array([len(x) for x in places], np.uint8).tobytes(), "places": np.concatenate(places).astype("<u4").tobytes(), "least": least.tobytes()}]
    to = (_bytes_hash(windows) % np.uint64(merges)).astype(np.int64)
    order = np.argsort(to, kind="stable")  # windows stay in order within a task's
    edges = np.flatnonzero(np.diff(to[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        own = order[a:b]
        said.append({"kind": WINDOWS, "number": int(to[own[0]]), "origin": number, "windows": windows[own].tobytes(), "places": own.astype("<u4").tobytes(), "least": least[own].tobytes()})
    return pd.DataFrame(said).reindex(columns=_names(SAID)).assign(origin=lambda x: x["origin"].fillna(0).astype("int64"))


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Sub-shards' windows merged by binary search; back goes where another sub-shard knows a lesser id. Lists are merged
    two by two, so a window is moved as often as the number of sub-shards can be halved."""
    lists = [(np.frombuffer(r.windows, f"S{LENGTH}"), np.frombuffer(r.least, "<i8")) for r in rows.itertuples(index=False)]
    turns = lists
    while len(turns) > 1:
        turns = [merged(*turns[i], *turns[i + 1])[:2] if i + 1 < len(turns) else turns[i] for i in range(0, len(turns), 2)]
    every, least = turns[0]
    out = []
    for (windows, own), row in zip(lists, rows.itertuples(index=False), strict=True):
        best = least[np.searchsorted(every, windows)]
        lesser = best < own
        if lesser.any():
            out.append((row.origin, np.frombuffer(row.places, "<u4")[lesser].tobytes(), best[lesser].tobytes()))
    return pd.DataFrame(out, columns=_names(LESSER))


def _settle(state: pd.DataFrame, lesser: pd.DataFrame, homes: int) -> pd.DataFrame:
    """A sub-shard's end: what is to go, by all sub-shards' least ids."""
    parts = []
    for row in state.itertuples(index=False):
        least = np.frombuffer(row.least, "<i8").copy()
        for x in lesser.itertuples(index=False):
            least[np.frombuffer(x.places, "<u4")] = np.frombuffer(x.least, "<i8")
        ends = np.cumsum(np.frombuffer(row.windows, np.uint8).astype(np.int64))
        places = np.split(np.frombuffer(row.places, "<u4"), ends[:-1])
        which, classes, ids, starts = (np.frombuffer(x, k) for x, k in ((row.which, "<u4"), (row.classes, "<i8"), (row.ids, "<i8"), (row.starts, "<u4")))
        parts.append(_gone([least[x] for x in places], which, classes, ids, starts, homes))
    return pd.concat(parts) if parts else pd.DataFrame(columns=_names(SAID))


def spans(size: int, starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + length)))
    return list(zip(starts[fresh].tolist(), (starts[np.append(fresh[1:], len(starts)) - 1] + length).tolist(), strict=True))


def _remove(texts: pd.DataFrame, gone: pd.DataFrame, with_text: bool) -> pd.DataFrame:
    """Texts of a bucket with their removed spans and what is kept."""
    by_class: dict[int, np.ndarray] = {}
    if len(gone):
        classes, starts, masks = (np.concatenate([np.frombuffer(x, kind) for x in gone[c]]) for c, kind in (("classes", "<i8"), ("starts", "<u4"), ("masks", "<u4")))
        bits = np.flatnonzero(np.unpackbits(masks.astype("<u4").view(np.uint8), bitorder="little"))
        windows, owner = starts[bits // 32].astype(np.int64) + bits % 32, classes[bits // 32]
        order = np.argsort(owner, kind="stable")
        owner, windows = owner[order], windows[order]
        edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        by_class = {int(owner[a]): windows[a:b] for a, b in zip(edges, np.append(edges[1:], len(owner)), strict=True)}
    out = []
    for number, text in zip(texts["class"], texts["text"], strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        runs = spans(len(raw), by_class.get(number, np.zeros(0, np.int64)))
        if runs:
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            out.append((number, [{"start": a, "end": b} for a, b in runs], kept if with_text else None, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["class", "removed", "kept", "kept_sha256"])


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_bytes: int = SHARD_BYTES, class_bits: int = 64, salts: int | None = None, sample: int = SAMPLE_BYTES, share: float = SHARE, **frequent) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``removed`` (array of byte spans), ``kept_bytes`` (null if nothing is
    removed, or without ``with_text``), ``sha256`` of the whole text and ``kept_sha256`` of what is kept.

    ``class_bits``: of the first hash by which texts are told apart. ``salts``: sub-shards of a frequent anchor.
    ``sample``, ``share`` and more: see ``sharedkeys.frequent``."""
    if id_col in ("n_bytes", "removed", "kept_bytes", "sha256", "kept_sha256"):
        raise ValueError(f"{id_col} is a column of the result")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    sha, first_hash = F.sha2(text.cast("binary"), 256), F.shiftrightunsigned(F.xxhash64(text), 64 - class_bits) if class_bits < 64 else F.xxhash64(text)
    narrow = common.cut(docs.select(F.col(id_col).alias("doc"), order.alias("id"), first_hash.alias("class"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha256")))
    reps = common.cut(narrow.groupBy("sha256").agg(F.min("id").alias("id"), F.min("class").alias("class")))
    clashing = frozenset(r[0] for r in reps.groupBy("class").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("class").collect())
    renamed = lambda number, digest: F.when(number.isin(*clashing), F.xxhash64(digest)).otherwise(number) if clashing else number
    narrow, reps = (x.withColumn("class", renamed(F.col("class"), F.col("sha256"))) for x in (narrow, reps))
    total = narrow.agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    size, rows = total["bytes"] or 0, total["rows"]

    hashes, _ = sharedkeys.frequent(docs, lambda text: np.unique(pieces(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))), size, text_col=text_col, sample=sample, share=share, **{"most": 1 << 18} | frequent)
    often = Often(hashes)

    def keys_of(text: str):
        raw = text.encode("utf-8", "surrogatepass")
        place, h, _ = anchors(np.frombuffer(raw, np.uint8), often=often)
        number = class_of(raw, class_bits)
        number = class_of(hashlib.sha256(raw).hexdigest().encode()) if number in clashing else number
        return (number, 0, np.unique(keys_of_places(h[np.unique(place)]))) if len(place) else None

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(c, keys.astype("<u8").tobytes()) for c, _, keys, _ in sharedkeys.gather(rows)], columns=["class", "keys"])

    table = sharedkeys.Frequent(np.unique(keys_of_places(hashes)), np.zeros(len(hashes), np.uint8))
    shared = sharedkeys.shared(docs, keys_of, size // ((LENGTH - PIECE + 2) // 2), each, "class long, keys binary", text_col=text_col, table=table)
    active = shared.join(reps.select("class", "id"), "class")
    texts = common.cut(docs.select(order.alias("id"), renamed(first_hash, sha).alias("class"), text.alias("text")).join(active, ["id", "class"]).dropDuplicates(["id", "class"]))
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(sharedkeys.LEAST_BUCKETS, -(-4 * held // shard_bytes))
    salts = salts or max(LEAST_SALTS, -(-rows // SUB_CLASSES))

    dealt = _stretches(texts, shards, salts, often).groupBy("shard").applyInPandas(lambda rows: _judge(rows, shards, shards, shard_bytes), SAID)
    if len(hashes):
        said = common.cut(dealt)
        state, windows = (said.where(F.col("kind") == k) for k in (STATE, WINDOWS))
        lesser = windows.groupBy("number").applyInPandas(_merge, LESSER)
        settled = state.groupBy("number").cogroup(lesser.groupBy("number")).applyInPandas(lambda a, b: _settle(a, b, shards), SAID)
        dealt = said.where(F.col("kind") == GONE).union(settled)
    gone = dealt.select(F.col("number").alias("home"), "classes", "starts", "masks")
    home = F.pmod(F.col("class"), F.lit(shards)).cast("int").alias("home")
    pair = texts.select(home, "class", "text").groupBy("home").cogroup(gone.groupBy("home"))
    removed = pair.applyInPandas(lambda a, b: _remove(a, b, with_text), "class long, removed array<struct<start:bigint,end:bigint>>, kept binary, kept_sha256 string")

    first = reps.select("sha256", F.col("id").alias("first")).join(narrow.select("doc", "id", "n_bytes", "class", "sha256"), "sha256")
    out = first.join(removed, "class", "left")
    copied = (F.col("id") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    kept_sha = F.when(copied, EMPTY).otherwise(F.coalesce("kept_sha256", "sha256"))
    kept = F.when(copied, F.lit(b"")).otherwise(F.col("kept")) if with_text else F.lit(None).cast("binary")
    return out.select(F.col("doc").alias(id_col), "n_bytes", F.when(copied, all_).otherwise(F.coalesce("removed", none)).alias("removed"), kept.alias("kept_bytes"), "sha256", kept_sha.alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(common.documents(spark, sf_dir), with_text=False)
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", lengths.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE_SQL = {
    "op5_suffix_dedup": r"""
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM t)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM w) WHERE first < doc_id),
islands AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, run),
pieces AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (coalesce(e, length(h) // 2) - s) AS BIGINT)), '' ORDER BY s) AS k FROM pieces JOIN t USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(k, h))) AS kept_sha256 FROM t LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
