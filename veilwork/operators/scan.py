"""Scanning for personal data that is left: e-mail addresses, social security numbers, card numbers, tokens.

Every string column is searched whole. Matches are found by built-in regular expressions; their places follow from the
running lengths of what is matched and what stands between, so a text of many matches takes no more for each of them. A token's patterns are tried in their order and a later match that
overlaps an earlier pattern's is not counted. Counts are summed per task and category before anything is shuffled; sample
places are the first few by row, taken from each task's first few.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.functions import arrays
from veilwork.functions.predicates import java_pattern
from veilwork.plans.policy import SEVERITIES, ScanSettings

#: The patterns of each category, tokens in the order in which they take precedence.
PATTERNS = {
    "email": (r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b",),
    "ssn": (r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b",),
    "pan": (r"\b(?:\d[ -]?){12,18}\d\b",),
    "token": (
        r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
        r"\bAKIA[0-9A-Z]{16}\b",
        r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
        r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
        r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?key)\s*[:=]\s*['\"]?[A-Za-z0-9._\-]{16,}\b",
    ),
}
SPAN = "array<struct<start:int,end:int,text:string>>"


def _pattern(pattern: str) -> str:
    return "(?U)" + java_pattern(pattern)


def spans(text: Column, pattern: str) -> Column:
    """Places (from 0, in code points, end exclusive) and texts of a pattern's matches."""
    pattern = _pattern(pattern)
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), matched.alias("text"))

    def placed(all_: Column) -> Column:
        before = arrays.prefix_sums(all_, lambda x: x["gap"] + F.coalesce(F.length(x["text"]), F.lit(0)))
        both = F.filter(F.arrays_zip(all_.alias("piece"), before.alias("at")), lambda z: z["piece"]["text"].isNotNull())
        start = lambda z: z["at"] + z["piece"]["gap"]
        return F.transform(both, lambda z: F.struct(start(z).alias("start"), (start(z) + F.length(z["piece"]["text"])).alias("end"), z["piece"]["text"].alias("text")))

    return F.when(text.rlike(pattern), arrays.let(pieces, placed)).otherwise(F.array().cast(SPAN))


def _clear(new: Column, old: Column) -> Column:
    """``old`` and what of ``new`` overlaps none of it. In order of starts (old) and ends (new), an old match that lies
    before a new one overlaps it if it ends after the new one's start."""
    event = lambda s, at, first: F.struct(at.alias("at"), F.lit(first).alias("old"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))
    events = F.array_sort(F.concat(F.transform(old, lambda s: event(s, s["start"], 1)), F.transform(new, lambda s: event(s, s["end"], 0))))

    def kept(all_: Column) -> Column:
        reach = arrays.prefix_greatest(all_, lambda e: F.when(e["old"] == 1, e["end"]).otherwise(-1))
        both = F.filter(F.arrays_zip(all_.alias("e"), reach.alias("reach")), lambda z: (z["e"]["old"] == 1) | (z["reach"] <= z["e"]["start"]))
        return F.transform(both, lambda z: F.struct(z["e"]["start"].alias("start"), z["e"]["end"].alias("end"), z["e"]["text"].alias("text")))

    return F.when((F.size(new) == 0) | (F.size(old) == 0), F.concat(old, new)).otherwise(arrays.let(events, kept))


def luhn(text: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def plausible_ssn(text: Column) -> Column:
    d = F.regexp_replace(text, "[^0-9]", "")
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


def found(text: Column, category: str) -> Column:
    """A category's matches in a text, by place."""
    if category == "token":
        return F.array_sort(reduce(lambda old, new: arrays.let(F.struct(old.alias("old"), new.alias("new")), lambda x: _clear(x["new"], x["old"])), (spans(text, p) for p in PATTERNS["token"])))
    return F.filter(spans(text, PATTERNS[category][0]), lambda m: _sound(m["text"], category))


def _sound(match: Column, category: str) -> Column:
    if category == "ssn":
        return plausible_ssn(match)
    if category == "pan":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(13, 19) & luhn(match)
    return F.lit(True)


def count(text: Column, category: str) -> Column:
    """How many matches of a category a text has. Places are only looked for where tokens of several patterns may overlap."""
    times = [F.coalesce(F.regexp_count(text, F.lit(_pattern(p))), F.lit(0)) for p in PATTERNS[category]]
    if category == "email":
        return F.when(F.contains(text, F.lit("@")), times[0]).otherwise(0)
    if category == "token":
        rare = [F.when(F.contains(text, F.lit(mark)), n).otherwise(0) for mark, n in zip(("eyJ", "AKIA", "gh", "xox", ""), times, strict=True)]
        several = lambda n: F.aggregate(F.transform(n, lambda x: (x > 0).cast("int")), F.lit(0), lambda s, x: s + x) > 1
        return arrays.let(F.array(*rare), lambda n: F.when(several(n), F.size(found(text, category))).otherwise(F.aggregate(n, F.lit(0), lambda s, x: s + x)))
    matched = F.regexp_extract_all(text, F.lit(_pattern(PATTERNS[category][0])), F.lit(0))
    return F.when(text.rlike("[0-9][ -]?[0-9]"), F.size(F.filter(matched, lambda m: _sound(m, category)))).otherwise(0)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def findings(df: DataFrame, columns: Sequence[str] | None = None, settings: ScanSettings = ScanSettings(), key: Column | None = None) -> DataFrame:
    """One row per match: row (``key``, or a running number), column, category, start and end (from 1), snippet."""
    columns = text_columns(df) if columns is None else list(columns)
    row = F.monotonically_increasing_id() if key is None else key
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(k).alias("category"), found(F.col(f"`{c}`"), k).alias("spans")) for c in columns for k in settings.categories()))
    each = df.select(row.alias("row"), F.explode(F.filter(cells, lambda x: F.size(x["spans"]) > 0)).alias("x"))
    each = each.select("row", "x.column", "x.category", F.explode("x.spans").alias("s"))
    return each.select("row", "column", "category", (F.col("s.start") + 1).alias("start"), (F.col("s.end") + 1).alias("end"), F.col("s.text").alias("snippet"))


def category_counts(df: DataFrame, columns: Sequence[str] | None = None, settings: ScanSettings = ScanSettings()) -> DataFrame:
    """One row per category searched: category, count. One pass and a sum; nothing is exploded."""
    columns = text_columns(df) if columns is None else list(columns)
    sums = [F.coalesce(F.sum(sum((count(F.col(f"`{c}`"), k) for c in columns), F.lit(0))), F.lit(0)).cast("long").alias(f"__count_{k}") for k in settings.categories()]
    listed = F.array(*(F.struct(F.lit(k).alias("category"), F.col(f"__count_{k}").alias("count")) for k in settings.categories()))
    return df.agg(*sums).select(F.explode(listed).alias("x")).select("x.*")


def gate(counts: DataFrame, settings: ScanSettings = ScanSettings()) -> DataFrame:
    """Counts with severity, threshold and whether the category fails: more than the threshold, and severe enough."""
    pick = lambda of: F.element_at(F.create_map(*(F.lit(x) for k in settings.categories() for x in (k, of(k)))), F.col("category"))
    severe = [c for c in settings.categories() if SEVERITIES.index(settings.severity(c)) >= SEVERITIES.index(settings.fail_on_severity)]
    failed = (F.col("count") > pick(settings.threshold)) & F.col("category").isin(severe)
    return counts.select("category", pick(settings.severity).alias("severity"), "count", pick(settings.threshold).cast("long").alias("threshold"), failed.alias("failed"))


def samples(found: DataFrame, settings: ScanSettings = ScanSettings()) -> DataFrame:
    """The first matches of each category by row, column and place."""
    limit = settings.sample_limit_per_category
    each = [found.where(F.col("category") == c).orderBy("row", "column", "start").limit(limit) for c in settings.categories()]
    return reduce(DataFrame.unionByName, each)


def report(df: DataFrame, columns: Sequence[str] | None = None, settings: ScanSettings = ScanSettings()) -> dict[str, Any]:
    """The scan's part of a run's report."""
    gated = gate(category_counts(df, columns, settings), settings).collect()
    places: dict[str, list] = {}
    for s in samples(findings(df, columns, settings), settings).collect() if any(g["count"] for g in gated) else []:
        places.setdefault(s["category"], []).append({"row": s["row"], "column": s["column"], "start_col": s["start"], "end_col": s["end"], "snippet": s["snippet"]})
    shown: list[Mapping[str, Any]] = [{"category": g["category"], "severity": g["severity"], "count": g["count"], "threshold": g["threshold"], **({"sample_locations": places[g["category"]]} if g["category"] in places else {})} for g in gated if g["count"]]
    failed = [g["category"] for g in gated if g["failed"]]
    out: dict[str, Any] = {"total_findings": sum(g["count"] for g in gated), "fail_on_severity": settings.fail_on_severity, "failed": bool(failed)}
    return out | ({"failed_categories": failed} if failed else {}) | ({"findings": shown} if shown else {})
