"""What a run has done: counters by table, events by cell, and the report as JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions import predicates
from veilwork.operators import domains
from veilwork.operators.masking import Masking


def _targeted(m: Masking, df: DataFrame, table: str) -> list[tuple[str, Any, Any]]:
    """(column, strategy of a row's cell, how many rule applications that is)."""
    out = []
    for name, p in m.plan(df, table).items():
        strategy = m.strategy_of(p, df.columns)
        times = F.when(strategy == "json", len(p.paths)).when(strategy.isNotNull(), 1).otherwise(0)
        out.append((name, strategy, times))
    return out


def counts(m: Masking, df: DataFrame, table: str) -> DataFrame:
    """One row: table, rows_processed, rows_dropped, and cells_targeted (rule applications on kept rows). One pass, partial sums."""
    keep = predicates.keep_row(m.policy.row_filter(table), df.columns)
    keep = F.lit(True) if keep is None else keep
    times = sum((t for _, _, t in _targeted(m, df, table)), F.lit(0))
    marked = df.select(keep.alias("keep"), times.alias("times"))
    return marked.agg(F.count(F.lit(1)).alias("rows_processed"), F.count_if(~F.col("keep")).alias("rows_dropped"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("times"))), F.lit(0)).cast("long").alias("cells_targeted")).select(F.lit(table).alias("table"), "*")


def cells_changed(m: Masking, df: DataFrame, table: str) -> DataFrame:
    """One row: table and cells_changed, the cells whose text is another than before. For policies without random draws."""
    kept = m.kept(df, table)
    plan = m.plan(kept, table)
    if not plan:
        return kept.agg(F.lit(0).cast("long").alias("cells_changed")).select(F.lit(table).alias("table"), "cells_changed")
    names = kept.columns
    own, unique = domains.attached(m, kept, table, plan)
    differs = lambda c: ~F.col(f"`{c}`").cast("string").eqNullSafe(m.column(plan[c], table, names, unique).cast("string"))
    pairs = own.select(*(differs(c).cast("int").alias(f"d{i}") for i, c in enumerate(plan)))
    total = sum((F.col(f"d{i}") for i in range(len(plan))), F.lit(0))
    return pairs.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("cells_changed")).select(F.lit(table).alias("table"), "cells_changed")


def events(m: Masking, df: DataFrame, table: str) -> DataFrame:
    """One row per dropped row and masked cell: type, table, column, strategy, original_was_null."""
    keep = predicates.keep_row(m.policy.row_filter(table), df.columns)
    keep = F.lit(True) if keep is None else keep
    event = lambda kind, column, strategy, was_null: F.struct(F.lit(kind).alias("type"), column.cast("string").alias("column"), strategy.cast("string").alias("strategy"), was_null.cast("boolean").alias("original_was_null"))
    none = F.lit(None)
    cells = [F.when(s.isNotNull(), event("CellChanged", F.lit(c), s, F.col(f"`{c}`").isNull())) for c, s, _ in _targeted(m, df, table)]
    listed = F.when(keep, F.filter(F.array(*cells), lambda e: e.isNotNull()) if cells else F.array().cast("array<struct<type:string,column:string,strategy:string,original_was_null:boolean>>"))
    all_ = listed.otherwise(F.array(event("RowDropped", none, none, none)))
    return df.select(F.explode(all_).alias("e")).select(F.lit(table).alias("table"), "e.*")


def domain_usage(m: Masking, tables: Mapping[str, Sequence[str]]) -> list[dict[str, Any]]:
    """Columns whose values come from a domain, each once."""
    found = {}
    for table, columns in sorted(tables.items()):
        schema, _, bare = table.rpartition(".")
        for column in columns:
            rule = m.policy.rule(table, column)
            specs = [c.spec for c in m.policy.cases(table, column)] + [rule] * (rule is not None) + [s for _, s in m.policy.json_rules(table, column, tuple(columns))]
            for spec in specs:
                if spec.domain:
                    found[table, column, spec.domain_key, spec.unique_within_domain] = {"schema": schema or None, "table": bare, "column": column, "domain": spec.domain, "unique_within_domain": spec.unique_within_domain}
    return list(found.values())


def summary(counted: Sequence[Any], *, hardened: bool, coverage: Mapping[str, Sequence[str]], usage: list, scan: Mapping | None = None, event_rows: Sequence[Any] = ()) -> dict[str, Any]:
    """The report. Lists of events and domains and the scan are left out where there are none."""
    per_table = {r["table"]: {"rows_processed": r["rows_processed"], "rows_dropped": r["rows_dropped"], "cells_changed": r["cells_targeted"]} for r in counted}
    total = lambda key: sum(t[key] for t in per_table.values())
    out = {
        "security_profile": "hardened" if hardened else "standard", "total_rows_processed": total("rows_processed"), "total_rows_dropped": total("rows_dropped"), "total_cells_changed": total("cells_changed"),
        **{f"sensitive_columns_{k}": list(coverage.get(k, ())) for k in ("detected", "covered", "uncovered")}, "per_table": per_table,
    }
    if event_rows:
        out["events"] = [{k: v for k, v in r.asDict().items() if v is not None or k != "column"} for r in event_rows]
    if scan is not None:
        out["output_scan"] = scan
    if usage:
        out["deterministic_mapping_domains"] = usage
    return out


def to_json(report: Mapping[str, Any]) -> str:
    return json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False)
