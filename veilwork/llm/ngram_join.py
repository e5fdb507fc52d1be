"""N-gram Jaccard join (operator 10): prefix filters under several global orders, intersected before verification.

A document is the set of its word shingles. Documents with equal sets form a class and go on as one. Two sets of Jaccard
similarity ``t`` or more must share a token among the first ``n - ceil(t n) + 1`` of each under any order of all tokens.
The orders used put rare tokens first (by the power of two of the number of classes that have them) and differ in how
they order tokens that are about as frequent. A token that one class alone has is shared with nobody, so a class with
enough of those is linked with nothing and leaves at once; for most of a corpus that is the end.

What remains is linked without listing the pairs of a group. For each prefix token of the first order one class of those
that have it is the centre; every other class is compared with the centre it shares most prefix tokens with. Further
rounds with other centres take what is not linked to its centre. Then whatever two classes share a prefix token, can be
similar by their sizes, by the tokens that are theirs alone and by how much of each comes after that token, and are still
not known to be connected are compared, all of them, so no link between different components is lost. A comparison first intersects the prefixes under the other orders and verifies on the whole sets only what passes all.
Components are then found by passing on the least number along links until nothing changes.

Tokens are 64-bit hashes of word sequences, 48 bits of which are compared; classes are 64-bit hashes of sets, with a
second hash where two sets have the same. Text null, empty or without words has no shingles and its own component. Fewer words than a shingle count as one shingle. Null ids
take part; a component's number is its least id that is not null. Repeated rows are in one class. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, sharedkeys

ORDERS = 3
ROUNDS = 2
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending. A-Z are lower-cased; ASCII white space parts words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            out = scramble(out + h[j : len(h) - size + 1 + j])
    return np.unique(out)


def class_of(tokens: np.ndarray, seed: int = 0, bits: int = 64) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) >> 64 - bits], np.uint64).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def prefixes(n: int, keys: np.ndarray, level: np.ndarray, percent: int) -> list[np.ndarray] | None:
    """Shared tokens in the prefix under each order; None if tokens of this class alone fill it."""
    need = prefix_size(n, percent) - (n - len(keys))
    if need <= 0:
        return None
    return [keys[np.lexsort((scramble(keys ^ np.uint64(salt)), level))[:need]] for salt in SALTS[:ORDERS]]


def _active(docs: DataFrame, total: int, words: int, percent: int, text_col: str, name: Callable[[np.ndarray], int], **sample) -> DataFrame:
    """Classes that may be linked: number, size, how many tokens are theirs alone, shared tokens and prefixes."""

    def keys_of(text: str):
        tokens = shingles(text, words)
        return (name(tokens), len(tokens), sharedkeys.key_of(tokens)) if len(tokens) else None

    often, times = sharedkeys.frequent(docs, lambda text: sharedkeys.key_of(shingles(text, words)), total, text_col=text_col, **sample)
    table = sharedkeys.Frequent(often, np.log2(np.maximum(times, 1)).astype(np.uint8))

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, n, keys, level in sharedkeys.gather(rows):
            found = prefixes(n, keys, level, percent)
            if found is not None:
                out.append((number, n, n - len(keys), keys.astype("<u8").tobytes(), found[0].astype(np.int64), *(p.astype("<u8").tobytes() for p in found[1:])))
        return pd.DataFrame(out, columns=["c", "n", "own", "tokens", "first", *(f"order{i}" for i in range(2, ORDERS + 1))])

    # sizes are multiplied below: 32 bits would overflow, an error under ANSI, from 2,148 own tokens on
    schema = "c long, n long, own long, tokens binary, first array<bigint>" + "".join(f", order{i} binary" for i in range(2, ORDERS + 1))
    return sharedkeys.shared(docs, keys_of, total, each, schema, text_col=text_col, table=table)


def verify(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Of pairs of classes (a, b) those whose sets are similar enough. Sizes and the prefixes under the other orders are
    looked at first; whole sets travel only to pairs that share a token in each."""
    orders = [f"order{i}" for i in range(2, ORDERS + 1)]

    def beside(few: DataFrame, columns: list[str]) -> DataFrame:
        side = lambda x: active.select(F.col("c").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in columns))
        return few.join(side("a"), "a").join(side("b"), "b")

    def shared(batch: pa.RecordBatch, name: str, i: int) -> int:
        return len(np.intersect1d(*(np.frombuffer(batch.column(f"{x}_{name}")[i].as_buffer(), "<u8") for x in "ab"), assume_unique=True))

    def keeping(batch: pa.RecordBatch, kept: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(x).take(pa.array(kept, pa.int64())) for x in "ab"], ["a", "b"])

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield keeping(batch, [i for i in range(batch.num_rows) if all(shared(batch, k, i) for k in orders)])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (m, n) in enumerate(zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)):
                both = shared(batch, "tokens", i)
                if 100 * both >= percent * (m + n - both):
                    kept.append(i)
            yield keeping(batch, kept)

    sized = beside(pairs, ["n", *orders]).where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    survivors = sized.select("a", "b", *(f"{x}_{k}" for k in orders for x in "ab")).mapInArrow(meets, "a long, b long")
    return beside(survivors, ["n", "tokens"]).mapInArrow(similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(c, component): for every class in ``links`` (a, b) the least number reachable."""
    both = common.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = common.cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("c"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("c", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = label.join(near.withColumnRenamed("a", "c"), "c").select("c", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = label.select(F.col("c").alias("component"), F.col("component").alias("above"))
        lower = lower.join(up, "component", "left").select("c", "was", F.least("component", F.coalesce("above", "component")).alias("component"))
        lower = common.cut(lower)
        if lower.where("was <> component").isEmpty():
            return lower.select("c", "component")
        label = lower.select("c", "component")


def possible(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets can be similar enough, seen from a token that both have in their prefixes.

    ``x`` and ``y`` have each set's size ``n``, how many tokens are its ``own``, and the token's place ``at`` in its order,
    from 1. The sets share no more tokens than either has that aren't its own; and if this is the first token they share,
    no more than come after it in either, and itself. At the first token that similar sets share both hold.
    """
    most = F.least(x["n"] - x["own"], y["n"] - y["own"])
    both = x["n"] + y["n"]
    needed = F.ceil(percent * both / (100 + percent))
    return (100 * most >= percent * (both - most)) & (x["at"] + needed - 1 <= x["n"]) & (y["at"] + needed - 1 <= y["n"])


def _size_bin(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(1.02))


def _labelled(links: DataFrame) -> DataFrame:
    """A class that is known to be connected with each: the least neighbour's least neighbour. Not all that are connected agree."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("c"), F.least("a", "b").alias("label"))
    two = one.select(F.col("c").alias("label"), F.col("label").alias("above"))
    return one.join(two, "label", "left").select("c", F.coalesce("above", "label").alias("label"))


def link(active: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all classes whose sets are similar enough."""
    seen = lambda n, own, at: F.struct(F.col(n).alias("n"), F.col(own).alias("own"), F.col(at).alias("at"))
    posted = active.select("c", "n", "own", F.posexplode("first").alias("i", "token")).withColumn("at", F.col("own") + F.col("i") + 1).drop("i")
    rank = [(F.col("own") * 1_000_000 / F.col("n")).cast("long") * 65536 + F.pmod(F.xxhash64("c"), F.lit(65536))]
    rank += [F.xxhash64("c", F.lit(i)) for i in range(1, ROUNDS)]
    chosen = [F.min_by(of, r).alias(f"centre_{of}{i}") for i, r in enumerate(rank) for of in ("c", "n", "own", "at")]
    centres = common.cut(posted.groupBy("token").agg(F.count(F.lit(1)).alias("many"), *chosen).where("many > 1"))
    posted = common.cut(posted.join(centres, "token"))
    links = None
    for i in range(ROUNDS):
        met = posted.where(possible(seen("n", "own", "at"), seen(f"centre_n{i}", f"centre_own{i}", f"centre_at{i}"), percent))
        met = met.select("c", F.col(f"centre_c{i}").alias("centre")).where("c <> centre")
        if links is not None:
            met = _apart(met, _labelled(links), "c", "centre")
        most = met.groupBy("c", "centre").agg(F.count(F.lit(1)).alias("times")).groupBy("c").agg(F.max_by("centre", F.col("times") * 65536 + F.pmod(F.xxhash64("centre"), F.lit(65536))).alias("centre"))
        found = verify(most.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct(), active, percent)
        links = common.cut(found if links is None else links.union(found))
    label = common.cut(components(links).withColumnRenamed("component", "label"))
    one = posted.join(label, "c", "left").select("token", "c", "n", "own", "at", F.coalesce("label", "c").alias("label"), F.col("centre_c0").alias("centre"))
    of_centre = label.select(F.col("c").alias("centre"), F.col("label").alias("centre_label"))
    one = common.cut(one.join(of_centre, "centre", "left").withColumn("astray", F.col("label") != F.coalesce("centre_label", "centre")))
    # what a class can be similar to has a size between bounds that its own tokens narrow; only those sizes are met
    left = F.col("n") - F.col("own")
    low, high = F.ceil(percent * F.col("n") / 100), F.floor(100 * left / percent) - F.col("n") + left
    side = lambda z: [F.col("c").alias(z), *(F.col(k).alias(f"{k}_{z}") for k in ("n", "own", "at", "label"))]
    a = one.where("astray").where((high >= low) & (high > 0)).select("token", *side("x"), F.explode(F.sequence(_size_bin(F.greatest(low, F.lit(1))), _size_bin(high))).alias("bin"))
    b = one.select("token", *side("y"), _size_bin(F.col("n")).alias("bin"))
    fits = (F.col("label_x") != F.col("label_y")) & possible(seen("n_x", "own_x", "at_x"), seen("n_y", "own_y", "at_y"), percent)
    rest = a.join(b, ["token", "bin"]).where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return common.cut(links.union(verify(rest, active, percent)))


def _apart(pairs: DataFrame, label: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs that aren't known to be connected."""
    label = common.cut(label)
    of = lambda c: label.select(F.col("c").alias(c), F.col("label").alias(f"label_{c}"))
    known = pairs.join(of(x), x, "left").join(of(y), y, "left")
    return known.where(F.coalesce(f"label_{x}", x) != F.coalesce(f"label_{y}", y)).select(x, y)


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = 5, percent: int = 80, class_bits: int = 64, **sample) -> DataFrame:
    """One row per row of ``docs``: id, ``row_col`` if given, ``n_shingles``, ``class`` and ``component``
    (numbers of its set of shingles and of the sets connected with it, null without shingles) and ``component_id``, the
    least id of all documents reachable by links of ``percent`` % similarity or more.

    ``class_bits``: bits of the first hash by which sets are told apart; sets that share one are told apart by a second hash
    of 64 bits. Among n sets some n * n / 2 ** 65 share one, and their numbers are given to the tasks. ``sample``: see
    ``sharedkeys.frequent``. An id column named like another column of the result is an error."""
    if taken := {id_col, row_col} & {"n_shingles", "class", "check", "component", "component_id"}:
        raise ValueError(f"{min(taken)} is a column of the result")
    kept = [id_col] + ([row_col] if row_col else [])
    source = docs.select(*kept, text_col)
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType()), T.StructField("check", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_batches(batches, text_col):
            sets = [shingles(t, words) for t in texts]
            found = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([class_of(s, *how) if len(s) else None for s in sets], pa.int64()) for how in ((0, class_bits), (1,)))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *found], schema.names)

    narrow = common.cut(source.mapInArrow(run, schema))
    total = narrow.agg(F.sum("n_shingles")).first()[0] or 0
    of = lambda rows: rows.where(F.col("class").isNotNull()).groupBy("class")
    classes = common.cut(of(narrow).agg(F.min(id_col).alias("least"), F.min("check").alias("low"), F.max("check").alias("high")))
    clashing = frozenset(r[0] for r in classes.where("low <> high").select("class").collect())
    if clashing:  # different sets of one number take their second hash
        narrow = narrow.withColumn("class", F.when(F.col("class").isin(*clashing), F.col("check")).otherwise(F.col("class")))
        classes = common.cut(of(narrow).agg(F.min(id_col).alias("least")))

    def name(tokens: np.ndarray) -> int:
        number = class_of(tokens, 0, class_bits)
        return class_of(tokens, 1) if number in clashing else number

    active = common.cut(_active(source, total, words, percent, text_col, name, **sample))
    component = components(link(active, percent))
    joined = classes.select("class", "least").join(component.withColumnRenamed("c", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    joined = common.cut(joined)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("class", "component", "component_id")
    return narrow.join(named, "class", "left").select(*kept, "n_shingles", "class", "component", F.when(F.col("class").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.documents(spark, sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE_SQL = {
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
often AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
f AS MATERIALIZED (SELECT e.* FROM e SEMI JOIN often USING (x)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
two AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS root FROM two UNION SELECT r.doc_id, two.b FROM r JOIN two ON r.root = two.a)
SELECT s.doc_id, len(sh) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT doc_id, min(root) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
}
