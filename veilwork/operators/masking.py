"""Applying a policy to a table: one filter and one select, which Catalyst prunes and pushes down like any others.

Filters, conditions and masks all look at the original row; nothing sees what another rule has written. A column gets the
first case that holds, else its rule, else the rules for paths inside it, else it passes through untouched.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import jsonpath, predicates
from veilwork.functions.strategies import always_quoted, draws_fresh, fresh, fresh_name, mask_column, mask_value
from veilwork.functions.stream import TAG, Profile
from veilwork.operators import domains
from veilwork.plans.policy import Policy, Spec


@dataclass(frozen=True)
class Masking:
    """A policy bound to a profile. ``lengths``: declared text lengths by lower-cased table and column; ``mappings``: see ``domains``."""

    policy: Policy
    profile: Profile = Profile()
    lengths: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    mappings: Mapping[tuple, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, policy: Policy, *, hardened: bool = False, seed: int | None = None, tag: bytes = TAG, **more) -> "Masking":
        return cls(policy, Profile(hardened=hardened, salt=policy.salt, seed=None if hardened else seed, tag=tag), **more)

    def most(self, table: str, column: str) -> int | None:
        for key in Policy._keys(table):
            if (n := self.lengths.get(key, {}).get(column.lower())) is not None:
                return n
        return None

    def with_unique(self, tables: Mapping[str, DataFrame], **more) -> "Masking":
        """With mappings for all columns of ``tables`` whose pseudonyms must be unique."""
        return Masking(self.policy, self.profile, self.lengths, domains.unique_mappings(self, {t: self.kept(d, t) for t, d in tables.items()}, **more))

    # -- rows ---------------------------------------------------------------------------------------------------------

    def kept(self, df: DataFrame, table: str) -> DataFrame:
        keep = predicates.keep_row(self.policy.row_filter(table), df.columns, strict=False)
        return df if keep is None else df.where(keep)

    # -- columns ------------------------------------------------------------------------------------------------------

    def plan(self, df: DataFrame, table: str) -> dict[str, "Plan"]:
        out = {}
        for i, f in enumerate(df.schema.fields):
            rule = self.policy.rule(table, f.name)
            cases = self.policy.cases(table, f.name)
            paths = self.policy.json_rules(table, f.name, tuple(df.columns)) if rule is None else []
            if rule is not None or cases or paths:
                out[f.name] = Plan(f, i, rule, cases, paths)
        return out

    def apply(self, df: DataFrame, table: str) -> DataFrame:
        """The masked table: rows dropped, cells masked, columns and their order as before."""
        df = self.kept(df, table)
        plan = self.plan(df, table)
        if not plan:
            return df
        names = df.columns
        df, unique = domains.attached(self, df, table, plan)
        seeds = {fresh_name(o): fresh() for p in plan.values() for o, s in p.specs() if draws_fresh(s, self.profile)}
        df = df.withColumns(seeds) if seeds else df
        return df.select(*(self.column(plan[c], table, names, unique).alias(c) if c in plan else F.col(f"`{c}`") for c in names))

    def column(self, p: "Plan", table: str, columns: list[str], unique: Mapping[tuple, Column]) -> Column:
        cell, most = F.col(f"`{p.field.name}`"), self.most(table, p.field.name)
        specs = [s for _, s in p.specs()]

        def masked(i: int, spec: Spec) -> Column:
            found = unique.get((p.field.name, i))
            out = mask_column(spec, self.profile, cell, p.field.dataType, ordinal=p.ordinal * 64 + i, most=most) if found is None else found
            return out.cast("long") if spec.strategy == "int_range" and isinstance(p.field.dataType, T.NumericType) else out

        if p.paths and p.rule is None:
            rest: Column | None = self.rewritten(cell, p.paths, most)
        else:
            rest = masked(len(p.cases), p.rule) if p.rule is not None else cell
        if not p.cases:
            return rest
        one_kind = len({s.strategy for s in specs}) == 1 and p.rule is not None
        as_text = (lambda c: c) if one_kind else (lambda c: c.cast("string"))
        chosen = None
        for i, case in enumerate(p.cases):
            when = F.when if chosen is None else chosen.when
            chosen = when(predicates.holds(case.when, columns), as_text(masked(i, case.spec)))
        return chosen.otherwise(as_text(rest))

    def rewritten(self, cell: Column, paths: list[tuple[tuple[str, ...], Spec]], most: int | None) -> Column:
        """JSON text with values masked at paths; a declared length cuts each value."""
        profile = self.profile

        @F.pandas_udf("string")
        def rewrite(texts: pd.Series) -> pd.Series:
            rules = [(path, lambda v, s=spec: mask_value(s, profile, v, most=most), bool(spec.as_string)) for path, spec in paths]
            return texts.map(lambda t: jsonpath.rewrite(t, rules)[0])

        # what draws at random must not be computed twice
        return (rewrite if all(s.domain or s.strategy == "hash" for _, s in paths) else rewrite.asNondeterministic())(cell.cast("string"))

    def strategy_of(self, p: "Plan", columns: list[str]) -> Column:
        """Name of the strategy that a row's cell gets: the case's, the rule's, or ``json`` for rules inside it."""
        rest = F.lit(p.rule.strategy if p.rule is not None else "json" if p.paths else None)
        chosen = None
        for case in p.cases:
            when = F.when if chosen is None else chosen.when
            chosen = when(predicates.holds(case.when, columns), F.lit(case.spec.strategy))
        return rest if chosen is None else chosen.otherwise(rest)

    def forced_quotes(self, p: "Plan", columns: list[str]) -> Column:
        """Whether a dump must quote the masked cell."""
        rest = F.lit(p.rule is not None and always_quoted(p.rule))
        chosen = None
        for case in p.cases:
            when = F.when if chosen is None else chosen.when
            chosen = when(predicates.holds(case.when, columns), F.lit(always_quoted(case.spec)))
        return rest if chosen is None else chosen.otherwise(rest)


@dataclass(frozen=True)
class Plan:
    """What happens to one column."""

    field: T.StructField
    ordinal: int
    rule: Spec | None
    cases: tuple
    paths: list

    def specs(self) -> list[tuple[int, Spec]]:
        """All specs, with numbers that tell them apart in the table."""
        return [(self.ordinal * 64 + i, s) for i, s in enumerate([*(c.spec for c in self.cases), *([self.rule] if self.rule is not None else [])])]


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)
