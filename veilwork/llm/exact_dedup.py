"""Exact dedup (operator 9): a static binary-fuse filter per immutable snapshot screens incoming digests.

Rows come in batches; each batch is a snapshot for those that follow. A row is reduced to the SHA-256 of its normalised
text; only that travels. Of a snapshot's distinct digests each bucket (a range of the digest) gets a binary-fuse filter,
built once and never changed, of about 10 bits a key. The distinct digests of a later batch probe the filter of their
bucket. Those that it denies are new for certain and are grouped among themselves only; those it allows join the
snapshot's groups of the same digest. Texts of all digests that more than one row has are then compared byte by byte; a
digest with different texts (none is known for SHA-256) is split by text.

Groups are counted with partial sums, so a group with a third of all rows costs its tasks one row each, and the joins
that carry rows back are plain equi-joins, whose hot keys Spark splits. Buckets are ranges of a hash whose number
follows the number of rows, so a task holds one bounded bucket.

Null text counts as empty; all empty texts are equal. Null ids are kept and lose against any id at a tie. Repeated rows
are members like any others. Empty tables give no rows. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\f\r"
BUCKET_ROWS = 1 << 17  # digests a bucket has, about
LEAST_BUCKETS = 64


# -- binary-fuse filter ---------------------------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scramble of 64-bit keys (murmur's finaliser) after adding the seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static filter of 8-bit fingerprints in three neighbouring segments: no false denials, about 1 false pass in 256."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = ((h >> np.uint64(32)) * np.uint64(segments - 2) >> np.uint64(32)).astype(np.int64) * segment
        low, mask = h & np.uint64(0xFFFFFFFF), np.uint64(segment - 1)
        return first + (low & mask).astype(np.int64), first + segment + ((low >> np.uint64(11)) & mask).astype(np.int64), first + 2 * segment + (((low * np.uint64(0x9E3779B1)) >> np.uint64(20)) & mask).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        """From distinct 64-bit keys. Slots that only one remaining key has are peeled in rounds, then filled in reverse."""
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(11, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) + 32
        segments = max(3, int(np.ceil(room / segment)) + 2)
        for seed in range(1, 1000):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            slots = np.stack(cls._slots(h, segment, segments))
            order = cls._peel(slots, segment * segments)
            if order is not None:
                break
            if seed % 10 == 0:
                segments += segments // 8 + 1
        else:
            raise ValueError("no seed peels")
        table, prints = np.zeros(segment * segments, np.uint8), cls._print(h)
        for rows, at in reversed(order):  # keys of one round have slots of their own, which no other key of the round touches
            table[at] = 0
            a, b, c = slots[:, rows]
            table[at] = prints[rows] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments, table)

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        index = np.zeros(size, np.int64)  # the exclusive or of the keys that have the slot
        for row in slots:
            np.bitwise_xor.at(index, row, np.arange(n))
        alive, order, left = np.ones(n, bool), [], n
        ready = np.flatnonzero(count == 1)
        while left:
            if not len(ready):
                return None
            rows = index[ready]
            rows, first = np.unique(rows, return_index=True)
            at = ready[first]
            order.append((rows, at))
            alive[rows] = False
            left -= len(rows)
            touched = slots[:, rows]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(index, row, rows)
            touched = np.unique(touched)
            ready = touched[count[touched] == 1]
        return order

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], np.uint64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return self._print(h) == self.table[a] ^ self.table[b] ^ self.table[c]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<u8").tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "BinaryFuse":
        seed, segment, segments = (int(x) for x in np.frombuffer(data, "<u8", 3))
        return cls(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


# -- operator ---------------------------------------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _key(digest: Column) -> Column:
    """The digest as the filters' 64-bit key."""
    return F.xxhash64(digest)


def build_filters(digests: DataFrame) -> DataFrame:
    """(bucket, filter) of the distinct (bucket, key) of a snapshot."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "filter": [BinaryFuse.build(rows["key"].to_numpy().view(np.uint64)).to_bytes()]})

    return digests.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The distinct incoming (bucket, key, digest) that their bucket's filter allows; a bucket without a filter allows none."""

    def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if held.empty or rows.empty:
            return rows.iloc[:0][["digest"]]
        return rows.loc[BinaryFuse.from_bytes(held["filter"].iloc[0]).holds(rows["key"].to_numpy().view(np.uint64)), ["digest"]]

    pair = incoming.select("bucket", "key", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket"))
    return pair.applyInPandas(probe, "digest string")


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Size and best row of each group: the most code points, then the smallest id (null last), then the first row. Ids are
    turned round by their bits, which no id overflows."""
    best = F.max(F.struct("chars", F.col("id").isNotNull().alias("known"), F.bitwise_not("id").alias("minus"), F.bitwise_not("row").alias("row"))).alias("best")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), best)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, batch: Column | None = None, batches: int = 2, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``digest`` of the normalised text.

    ``batch``: the number, from 0 to ``batches`` - 1, of the batch in which a row arrives; by default dealt by a hash of
    the id. ``id_col`` must be an integer. ``row_col``: an integer that tells rows with the same id apart; it is returned,
    and of such rows only the first stays (without it, all that have the id that stays). ``digest``: from normalised text to a string; another than SHA-256 is for tests.
    """
    text = normalised(F.col(text_col))
    batch = F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int") if batch is None else batch.cast("int")
    buckets = max(LEAST_BUCKETS, -(-docs.count() // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(F.lit(7), F.col("digest")), F.lit(buckets)).cast("int")
    row = F.col(row_col) if row_col else F.lit(0)
    columns = [F.col(id_col).alias("id"), row.cast("long").alias("row"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"), digest(text).alias("digest")]
    narrow = common.cut(docs.select(*columns, batch.alias("batch")))
    groups = common.cut(_grouped(narrow, "batch", "digest").select("*", bucket.alias("bucket"), _key(F.col("digest")).alias("key")))

    # each batch's digests against the filters of the snapshots before it; what they allow joins the exact buckets
    matched = None
    for b in range(1, batches):
        incoming = groups.where(F.col("batch") == b)
        for earlier in range(b):
            snapshot = groups.where(F.col("batch") == earlier)
            passed = screen(incoming, build_filters(snapshot))
            found = passed.join(snapshot.select("digest"), "digest")
            matched = found if matched is None else matched.union(found)
    repeated = groups.where("size > 1").select("digest")
    if matched is not None:
        matched = common.cut(matched.distinct())
        repeated = repeated.union(matched).distinct()

    split = _different_texts(docs, repeated, text_col, digest)
    if split.isEmpty():
        whole, keys = narrow, ["digest"]
    else:
        whole = docs.select(*columns, text.alias("norm"))
        whole = whole.join(split.withColumn("split", F.lit(True)), "digest", "left").withColumn("norm", F.when(F.col("split"), F.col("norm")).otherwise(F.lit("")))
        keys = ["digest", "norm"]
    total = _grouped(whole, *keys) if len(keys) > 1 else _joined(groups, matched)
    members = total.where("size > 1").select(*keys, F.col("size"), F.when(F.col("best.known"), F.bitwise_not("best.minus")).alias("keep"), F.bitwise_not("best.row").alias("keep_row"), F.lit(True).alias("many"))
    out = whole.join(members, keys, "left")
    keep = F.when(F.col("many"), F.col("keep")).otherwise(F.col("id"))
    kept = keep.eqNullSafe(F.col("id")) & (F.coalesce("keep_row", "row") == F.col("row"))
    columns = [F.col("row").alias(row_col)] if row_col else []
    return out.select(F.col("id").alias(id_col), *columns, keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("digest"))


def _joined(groups: DataFrame, matched: DataFrame | None) -> DataFrame:
    """Groups over all batches: those of matched digests are added up, the others stand as they are."""
    if matched is None:
        return groups.select("digest", "size", "best")
    alone = groups.join(matched, "digest", "left_anti").select("digest", "size", "best")
    both = groups.join(matched, "digest", "left_semi").groupBy("digest").agg(F.sum("size").alias("size"), F.max("best").alias("best"))
    return alone.union(both)


def _different_texts(docs: DataFrame, repeated: DataFrame, text_col: str, digest) -> DataFrame:
    """Digests that rows of different normalised texts have. The texts are keys of a sum, so they are compared byte by byte."""
    text = normalised(F.col(text_col))
    rows = docs.select(digest(text).alias("digest"), text.alias("norm")).join(repeated, "digest", "left_semi")
    texts = rows.groupBy(F.concat(F.col("digest"), F.lit("")).alias("digest"), "norm").agg(F.count(F.lit(1)).alias("n"))
    return common.cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE_SQL = {
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
}
