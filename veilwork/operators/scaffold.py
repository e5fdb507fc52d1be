"""A draft policy from the names of columns, and from sampled values if asked."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import jsonpath
from veilwork.operators.coverage import likely_spec
from veilwork.plans.policy import Spec

SAMPLE_ROWS = 5
MAX_DEPTH = 24
#: The most bytes of a text that is looked at for an address and for an e-mail address.
MOST_ADDRESS, MOST_EMAIL = 512, 320
#: A postal code, a line that reads like a street.
POSTAL_CODE = re.compile(r"\b\d{5}(?:-\d{4})?\b")
STREET = re.compile(r"(?i)^\s*\d+\s+\S.+\s+(st|street|ave|avenue|rd|road|blvd|boulevard|ln|lane|dr|drive|ct|court|pl|place|way)\.?\s*$")

Rules = dict[str, dict[str, Spec]]


def from_text(text: str) -> Spec | None:
    """What a value itself suggests: an address's line or code, or an e-mail address."""
    t = text.strip()
    if not t or "\n" in t:
        return None
    if len(t.encode()) <= MOST_ADDRESS and (POSTAL_CODE.search(t) or STREET.match(t)):
        return Spec("redact", as_string=True)
    before, mark, after = t.partition("@")
    if mark and len(t.encode()) <= MOST_EMAIL and "." in after and before.strip():
        return Spec("email", as_string=True)
    return None


def suggested(text: Column) -> Column:
    """The strategy that a value itself suggests, as a column."""

    @F.pandas_udf("string")
    def strategies(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or (found := from_text(t)) is None else found.strategy)

    return strategies(text)


def by_names(tables: Mapping[str, list[str]]) -> Rules:
    """Rules by table for columns whose names tell."""
    out = {t.lower(): {c.lower(): s for c in columns if (s := likely_spec(c))} for t, columns in tables.items()}
    return {t: r for t, r in out.items() if r}


def walk(value: Any, name: str, max_depth: int, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], Spec]:
    """Rules for what lies inside a JSON value, by path; an array's places are numbers. ``name``: of what holds the value."""
    if len(path) > max_depth:
        return {}
    items = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value)) if isinstance(value, list) else None
    out: dict[tuple[str, ...], Spec] = {}
    if items is None:
        text = jsonpath.leaf_text(value)
        spec = None if text is None else likely_spec(name) or from_text(text)
        return {path: spec} if spec and path else {}
    for key, inner in items:
        for p, spec in walk(inner, name if key.isdigit() and isinstance(value, list) else key, max_depth, (*path, key)).items():
            out.setdefault(p, spec)
    return out


def sample(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """A few rows at random: each task keeps its own few, so nothing else travels."""
    return df.orderBy(F.rand(seed)).limit(n)


def draft(tables: Mapping[str, DataFrame], *, infer_json: bool = False, max_depth: int = MAX_DEPTH, seed: int = 0) -> Rules:
    """Rules from names; with ``infer_json`` also from sampled values. Rules for paths inside a column replace its own."""
    rules = by_names({t: d.columns for t, d in tables.items()})
    if not infer_json:
        return rules
    for table, df in tables.items():
        own = rules.setdefault(table.lower(), {})
        texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
        for row in sample(texts, seed=seed).collect():
            for column in df.columns:
                _consider(own, column.lower(), row[column], max_depth)
    return {t: r for t, r in rules.items() if r}


def _consider(own: dict[str, Spec], column: str, text: str | None, max_depth: int) -> None:
    if text is None:
        return
    try:
        value = jsonpath.parse(text)
    except (ValueError, RecursionError):
        if (spec := from_text(text)) and not any(k.startswith(column + ".") for k in own):
            own.setdefault(column, spec)
        return
    if isinstance(value, (dict, list)):
        paths = walk(value, column, max_depth)
        if paths:
            own.pop(column, None)
        for path, spec in paths.items():
            own.setdefault(".".join((column, *path)), spec)
    elif value is not None and (spec := likely_spec(column) or from_text(jsonpath.leaf_text(value) or "")):
        own.setdefault(column, spec)


def to_toml(rules: Rules) -> str:
    """The draft as TOML, sorted."""
    out = ["# Draft from column names: read every rule before it is used.\n"]
    for table, columns in sorted(rules.items()):
        out.append(f"[rules.{_key(table)}]")
        for column, spec in sorted(columns.items()):
            fields = ", ".join(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in spec.as_dict().items())
            out.append(f"{_key(column)} = {{ {fields} }}")
        out.append("")
    return "\n".join(out)


def _key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9_-]+", name) else json.dumps(name, ensure_ascii=False)
