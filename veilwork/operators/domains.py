"""Unique pseudonyms: within a domain different values get different ones.

A value's k-th candidate is its masked value with collision number k. Values take their lowest candidate that no value
before them has, in the order of (k, value). All candidates come from a hash, so a round aggregates the candidates of the
values that are not settled; the settled ones are only joined against. A round looks at one candidate of each value, or at
more once few values are left, so that it never costs much more than the first. What remains after ``RETRIES`` candidates,
or once all pseudonyms that the strategy can draw are given away, keeps its first.
The mapping is a table of its distinct values, written to the shared checkpoint folder round by round; a table is masked
by an equi-join with it, which Spark broadcasts if it is small and splits where one value is frequent.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.strategies import mask_column, space
from veilwork.operators.storage import cut, place
from veilwork.plans.policy import Spec

if TYPE_CHECKING:
    from veilwork.operators.masking import Masking, Plan

RETRIES = 4096
AHEAD = 256  # candidates of a value that a round looks at, at most
ROUND = 1 << 16  # candidates that a round looks at however few values there are, and those of a task
MOST_BROADCAST = 100_000  # values of a mapping that Spark may broadcast


def key_of(spec: Spec, most: int | None) -> tuple:
    """Columns with equal keys share a mapping."""
    return tuple(sorted({**spec.as_dict(), "domain": spec.domain_key}.items())) + (most,)


def _unique_specs(m: "Masking", df: DataFrame, table: str) -> list[tuple[str, int, Spec, int | None]]:
    out = []
    for name, p in m.plan(df, table).items():
        specs = [c.spec for c in p.cases] + ([p.rule] if p.rule is not None else [])
        out += [(name, i, s, m.most(table, name)) for i, s in enumerate(specs) if s.unique_within_domain]
    return out


def unique_mappings(m: "Masking", tables: Mapping[str, DataFrame], retries: int = RETRIES) -> dict[tuple, DataFrame]:
    """Mapping (value, pseudonym) by key, over all columns of all tables that share it."""
    values: dict[tuple, tuple[Spec, int | None, DataFrame]] = {}
    for table, df in tables.items():
        for name, _, spec, most in _unique_specs(m, df, table):
            own = df.select(F.col(f"`{name}`").cast("string").alias("value")).where("value IS NOT NULL")
            key = key_of(spec, most)
            values[key] = (spec, most, values[key][2].union(own) if key in values else own)
    return {key: assign(m, spec, most, rows.distinct(), retries) for key, (spec, most, rows) in values.items()}


def assign(m: "Masking", spec: Spec, most: int | None, values: DataFrame, retries: int = RETRIES, taken: DataFrame | None = None) -> DataFrame:
    """(value, pseudonym) of each of ``values``, which are distinct. Those of ``taken`` are given to none while candidates last."""
    candidate = lambda k: mask_column(spec, m.profile, F.col("value"), k=k, most=most).cast("string")
    without = lambda rows, others, c: rows.join(others.select(c).hint("merge"), c, "left_anti").select(*rows.columns)
    left = cut(values.select("value"))
    every = waiting = left.count()
    room, path, settled, given = space(spec), place(values.sparkSession), None, 0
    before = 0 if taken is None or room is None else taken.select("pseudonym").distinct().count()
    k, ahead = 0, 1
    while waiting and k <= retries + 1 and (room is None or given + before < room):
        tried = left.repartition(-(-waiting * ahead // ROUND), "value").select("value", F.explode(F.sequence(F.lit(k).cast("long"), F.lit(k + ahead - 1).cast("long"))).alias("k"))
        open_ = tried.select("value", "k", candidate(F.col("k")).alias("pseudonym"))
        for others in (taken, settled):
            open_ = open_ if others is None else without(open_, others, "pseudonym")
        while True:
            open_ = cut(open_)
            won = open_.groupBy("pseudonym").agg(F.min(F.struct("k", "value")).alias("best")).select("best.value", "best.k", "pseudonym")
            if ahead > 1:  # an earlier candidate of the value may still be open
                won = won.join(open_.groupBy("value").agg(F.min("k").alias("k")).hint("merge"), ["value", "k"])
            won = cut(won.select("value", "pseudonym"))
            n = won.count()
            if n:
                settled = cut(won, path)
                left = cut(without(left, won, "value"))
                given, waiting = given + n, waiting - n
            if not n or ahead == 1 or not waiting:
                break
            open_ = without(without(open_, won, "value"), won, "pseudonym")
        k += ahead
        ahead = max(1, min(AHEAD, (every // 8 + ROUND) // max(1, waiting), retries + 2 - k))
    if waiting or settled is None:
        settled = cut(left.select("value", candidate(0).alias("pseudonym")), path)
    return settled.hint("merge") if every > MOST_BROADCAST else settled


def attached(m: "Masking", df: DataFrame, table: str, plan: Mapping[str, "Plan"]) -> tuple[DataFrame, dict[tuple, Column]]:
    """The table with pseudonyms joined to it, and the column for each (column, spec's place)."""
    out: dict[tuple, Column] = {}
    for n, (name, i, spec, most) in enumerate(_unique_specs(m, df, table)):
        mapping = m.mappings.get(key_of(spec, most))
        if mapping is None:
            mapping = unique_mappings(m, {table: df})[key_of(spec, most)]
        source, found = f"__value_{n}", f"__pseudonym_{n}"
        df = df.join(mapping.select(F.col("value").alias(source), F.col("pseudonym").alias(found)), F.col(f"`{name}`").cast("string") == F.col(source), "left").drop(source)
        out[name, i] = F.col(found)
    return df, out
