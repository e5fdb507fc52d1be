"""Policies: TOML to a validated, frozen description of what to filter, mask, check and scan."""

from __future__ import annotations

import os
import re
import tomllib
import warnings
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

CONFIG_NAME = ".veilwork.toml"
TOOL_TABLE = "veilwork"


class PolicyError(ValueError):
    """A policy that can't be used; the message names the place in it."""


# -- strategies ---------------------------------------------------------------------------------------------------------

STRATEGIES = (
    "null", "redact", "blank", "empty_array", "empty_object", "uuid", "hash", "email", "name", "first_name", "last_name", "phone",
    "int_range", "decimal", "payment_card", "string", "faker", "date_fuzz", "time_fuzz", "datetime_fuzz",
)
CONSTANT = ("null", "redact", "blank", "empty_array", "empty_object")
LOCALES = ("en", "fr_fr", "de_de", "it_it", "pt_br", "pt_pt", "ar_sa", "zh_cn", "zh_tw", "ja_jp", "cy_gb")
#: Option: the strategies that take it.
TAKES = {
    "salt": ("hash",),
    "min": ("int_range", "faker", "decimal"),
    "max": ("int_range", "faker", "decimal"),
    "length": ("string", "faker", "payment_card"),
    "scale": ("decimal",),
    "format": ("faker",),
    "faker": ("faker",),
    "min_days": ("date_fuzz",),
    "max_days": ("date_fuzz",),
    "min_seconds": ("time_fuzz", "datetime_fuzz"),
    "max_seconds": ("time_fuzz", "datetime_fuzz"),
    "locale": ("faker", "phone", "email", "name", "first_name", "last_name"),
}
#: Bounds that hold when none are given.
BOUNDS = {"int_range": (0, 1_000_000), "decimal": (0, 1_000_000), "date_fuzz": (-30, 30), "time_fuzz": (-300, 300), "datetime_fuzz": (-86_400, 86_400)}
BOUND_KEYS = {"int_range": ("min", "max"), "decimal": ("min", "max"), "date_fuzz": ("min_days", "max_days"), "time_fuzz": ("min_seconds", "max_seconds"), "datetime_fuzz": ("min_seconds", "max_seconds")}


@dataclass(frozen=True)
class Spec:
    """One masking strategy with its options."""

    strategy: str
    salt: str | None = None
    min: int | None = None
    max: int | None = None
    scale: int | None = None
    length: int | None = None
    min_days: int | None = None
    max_days: int | None = None
    min_seconds: int | None = None
    max_seconds: int | None = None
    domain: str | None = None
    unique_within_domain: bool = False
    as_string: bool | None = None
    locale: str | None = None
    faker: str | None = None
    format: str | None = None

    @property
    def bounds(self) -> tuple[int, int]:
        low, high = BOUND_KEYS[self.strategy]
        first, last = BOUNDS[self.strategy]
        return (first if getattr(self, low) is None else getattr(self, low), last if getattr(self, high) is None else getattr(self, high))

    @property
    def domain_key(self) -> str | None:
        """The domain as it is compared: without outer blanks, ASCII letters lower-cased."""
        return None if self.domain is None else ascii_lower(self.domain.strip())

    def as_dict(self) -> dict[str, Any]:
        return {f.name: v for f in fields(self) if (v := getattr(self, f.name)) is not None and v is not False}


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


_KINDS = {"strategy": str, "salt": str, "domain": str, "locale": str, "faker": str, "format": str, "unique_within_domain": bool, "as_string": bool}


def parse_spec(raw: Any, where: str) -> Spec:
    if not isinstance(raw, Mapping):
        raise PolicyError(f"{where} must be a table with a strategy")
    known = {f.name for f in fields(Spec)}
    for key, value in raw.items():
        if key not in known:
            raise PolicyError(f"{where}.{key} is not an option")
        kind = _KINDS.get(key, int)
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise PolicyError(f"{where}.{key} must be {'an integer' if kind is int else 'a boolean' if kind is bool else 'a string'}")
    if "strategy" not in raw:
        raise PolicyError(f"{where} has no strategy")
    spec = Spec(**{**raw, "strategy": raw["strategy"].lower()})
    _check_spec(spec, where)
    return spec


def _check_spec(spec: Spec, where: str) -> None:
    from veilwork.functions import fakes

    s = spec.strategy
    if s not in STRATEGIES:
        raise PolicyError(f"{where}.strategy {s!r} is unknown; known are {', '.join(STRATEGIES)}")
    if spec.domain is not None and not spec.domain.strip():
        raise PolicyError(f"{where}.domain is empty")
    if spec.unique_within_domain and spec.domain is None:
        raise PolicyError(f"{where}.unique_within_domain needs a domain")
    if spec.domain is not None and s in CONSTANT:
        raise PolicyError(f"{where}.domain can't be used with {s}, whose values don't depend on the source")
    for option, takers in TAKES.items():
        if getattr(spec, option) is not None and s not in takers:
            raise PolicyError(f"{where}.{option} can't be used with {s}, only with {', '.join(takers)}")
    if spec.locale is not None and spec.locale.lower() not in LOCALES:
        raise PolicyError(f"{where}.locale {spec.locale!r} is unknown; known are {', '.join(LOCALES)}")
    if s in BOUND_KEYS and spec.bounds[0] > spec.bounds[1]:
        raise PolicyError(f"{where}: {BOUND_KEYS[s][0]} ({spec.bounds[0]}) must not exceed {BOUND_KEYS[s][1]} ({spec.bounds[1]})")
    if spec.scale is not None and not 0 <= spec.scale <= 38:
        raise PolicyError(f"{where}.scale must lie between 0 and 38 (got {spec.scale})")
    if s == "payment_card" and spec.length is not None and not 13 <= spec.length <= 19:
        raise PolicyError(f"{where}.length must lie between 13 and 19 for payment_card (got {spec.length})")
    if spec.length is not None and spec.length < 1:
        raise PolicyError(f"{where}.length must be 1 or more")
    if s == "faker":
        if not (spec.faker or "").strip():
            raise PolicyError(f'{where}.faker is missing, such as faker = "internet::SafeEmail"')
        if fakes.parse_path(spec.faker) is None:
            raise PolicyError(f'{where}.faker must look like "module::Type" (got {spec.faker!r})')
        if not fakes.is_supported(spec):
            raise PolicyError(f"{where}.faker {spec.faker!r} is not a supported generator, or lacks an option that it needs")


# -- predicates, cases --------------------------------------------------------------------------------------------------

OPERATORS = ("eq", "neq", "in", "not_in", "like", "ilike", "regex", "iregex", "lt", "lte", "gt", "gte", "is_null", "not_null")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: Any = None
    values: tuple | None = None
    case_insensitive: bool = False


@dataclass(frozen=True)
class When:
    any: tuple[Predicate, ...] = ()
    all: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Case:
    when: When
    spec: Spec


@dataclass(frozen=True)
class RowFilter:
    retain: tuple[Predicate, ...] = ()
    delete: tuple[Predicate, ...] = ()


def parse_predicate(raw: Any, where: str) -> Predicate:
    if not isinstance(raw, Mapping) or not isinstance(raw.get("column"), str) or not isinstance(raw.get("op"), str):
        raise PolicyError(f"{where} must be a table with a column and an op")
    if unknown := set(raw) - {f.name for f in fields(Predicate)}:
        raise PolicyError(f"{where}.{min(unknown)} is not an option")
    op = raw["op"].lower()
    if op not in OPERATORS:
        raise PolicyError(f"{where}.op {op!r} is unknown; known are {', '.join(OPERATORS)}")
    values = raw.get("values")
    if values is not None and not isinstance(values, list):
        raise PolicyError(f"{where}.values must be an array")
    if op in ("regex", "iregex"):
        from veilwork.functions.predicates import java_pattern

        try:
            re.compile(str(raw.get("value", "")).replace(r"\z", r"\Z"))
        except re.error as bad:
            raise PolicyError(f"{where}.value is not a regular expression: {bad}") from None
        java_pattern(str(raw.get("value", "")))
    return Predicate(raw["column"], op, raw.get("value"), None if values is None else tuple(values), bool(raw.get("case_insensitive", False)))


# -- JSON paths ---------------------------------------------------------------------------------------------------------


def split_key(key: str) -> tuple[str, tuple[str, ...]]:
    """A rule's or predicate's key as column and path; segments keep their case. ``__`` goes before dots."""
    for mark in ("__", "."):
        head, *rest = (p.strip() for p in key.split(mark))
        path = tuple(p for p in rest if p)
        if head and path:
            return head, path
    return key, ()


# -- output scan --------------------------------------------------------------------------------------------------------

CATEGORIES = ("email", "ssn", "pan", "token")
SEVERITIES = ("low", "medium", "high", "critical")


@dataclass(frozen=True)
class ScanSettings:
    enabled_categories: tuple[str, ...] = ()
    default_threshold: int = 0
    default_severity: str = "high"
    fail_on_severity: str = "low"
    sample_limit_per_category: int = 5
    thresholds: Mapping[str, int] = field(default_factory=dict)
    severities: Mapping[str, str] = field(default_factory=dict)

    def categories(self) -> tuple[str, ...]:
        return tuple(c for c in CATEGORIES if not self.enabled_categories or c in self.enabled_categories)

    def threshold(self, category: str) -> int:
        return self.thresholds.get(category, self.default_threshold)

    def severity(self, category: str) -> str:
        return self.severities.get(category, self.default_severity)


def _scan(raw: Any) -> ScanSettings:
    if not isinstance(raw, Mapping):
        raise PolicyError("output_scan must be a table")
    if unknown := set(raw) - {f.name for f in fields(ScanSettings)}:
        raise PolicyError(f"output_scan.{min(unknown)} is not an option")
    category = lambda c, where: c.lower() if c.lower() in CATEGORIES else _fail(f"{where}: category {c!r} is unknown; known are {', '.join(CATEGORIES)}")
    severity = lambda s, where: s.lower() if s.lower() in SEVERITIES else _fail(f"{where}: severity {s!r} is unknown; known are {', '.join(SEVERITIES)}")
    out: dict[str, Any] = dict(raw)
    out["enabled_categories"] = tuple(category(c, "output_scan.enabled_categories") for c in raw.get("enabled_categories", ()))
    for key in ("default_severity", "fail_on_severity"):
        if key in raw:
            out[key] = severity(raw[key], f"output_scan.{key}")
    out["thresholds"] = {category(c, "output_scan.thresholds"): int(n) for c, n in raw.get("thresholds", {}).items()}
    out["severities"] = {category(c, "output_scan.severities"): severity(s, f"output_scan.severities.{c}") for c, s in raw.get("severities", {}).items()}
    return ScanSettings(**out)


def _fail(message: str) -> str:
    raise PolicyError(message)


# -- policies -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    """Rules by lower-cased table (``table`` or ``schema.table``). Rule keys are as written, their base column lower-cased."""

    salt: str | None = None
    rules: Mapping[str, Mapping[str, Spec]] = field(default_factory=dict)
    row_filters: Mapping[str, RowFilter] = field(default_factory=dict)
    column_cases: Mapping[str, Mapping[str, tuple[Case, ...]]] = field(default_factory=dict)
    sensitive_columns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    output_scan: ScanSettings = ScanSettings()
    keep_original: bool = False
    pg_restore_path: str | None = None
    pg_restore_args: tuple[str, ...] = ()
    source: str | None = None

    # lookups: schema.table first, then the bare table; per column for rules and cases, as a whole for filters and lists

    @staticmethod
    def _keys(table: str) -> list[str]:
        table = table.lower()
        return [table, table.rsplit(".", 1)[1]] if "." in table else [table]

    def rule(self, table: str, column: str) -> Spec | None:
        for key in self._keys(table):
            for name, spec in self.rules.get(key, {}).items():
                if name.lower() == column.lower():
                    return spec
        return None

    def cases(self, table: str, column: str) -> tuple[Case, ...]:
        for key in self._keys(table):
            for name, cases in self.column_cases.get(key, {}).items():
                if name == column.lower():
                    return cases
        return ()

    def row_filter(self, table: str) -> RowFilter | None:
        return next((self.row_filters[k] for k in self._keys(table) if k in self.row_filters), None)

    def sensitive(self, table: str) -> tuple[str, ...]:
        return next((self.sensitive_columns[k] for k in self._keys(table) if k in self.sensitive_columns), ())

    def json_rules(self, table: str, column: str, columns: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Spec]]:
        """Path rules of a column, the longest path first; a qualified table's rule goes before the bare one's for a path.
        A key that is the name of one of ``columns`` is no path."""
        names = {c.lower() for c in columns}
        found: dict[tuple[str, ...], Spec] = {}
        for key in self._keys(table):
            for name, spec in self.rules.get(key, {}).items():
                base, path = split_key(name)
                if path and name.lower() not in names and base.lower() == column.lower():
                    found.setdefault(path, spec)
        return sorted(found.items(), key=lambda x: (-len(x[0]), x[0]))

    def specs(self) -> Iterator[tuple[str, str, Spec]]:
        """All specs with their table and column key, cases included."""
        for table, columns in sorted(self.rules.items()):
            for column, spec in sorted(columns.items()):
                yield table, column, spec
        for table, cased in sorted(self.column_cases.items()):
            for column, cases in sorted(cased.items()):
                for case in cases:
                    yield table, column, case.spec

    @property
    def is_empty(self) -> bool:
        return not (self.rules or self.row_filters or self.column_cases)


_TOP = ("salt", "rules", "row_filters", "column_cases", "sensitive_columns", "output_scan", "keep_original", "pg_restore", "table_options")


def build(raw: Mapping[str, Any], source: str | None = None) -> Policy:
    """From parsed TOML: secrets resolved, everything checked."""
    if "table_options" in raw:
        raise PolicyError("table_options is no longer supported; use rules and column_cases")
    if unknown := set(raw) - set(_TOP):
        raise PolicyError(f"{min(unknown)} is not a section of a policy")
    raw = resolve_secrets(raw)
    rules: dict[str, dict[str, Spec]] = {}
    for table, columns in _tables(raw, "rules"):
        own = rules.setdefault(table.lower(), {})
        for column, spec in columns.items():
            base, path = split_key(column)
            own[column if path else column.lower()] = parse_spec(spec, f'rules."{table}".{column}')
        _check_paths(table, own)
    filters = {}
    for table, lists in _tables(raw, "row_filters"):
        if unknown := set(lists) - {"retain", "delete", "include_any", "exclude_any"}:
            raise PolicyError(f'row_filters."{table}".{min(unknown)} is not an option')
        pick = lambda new, old: tuple(parse_predicate(p, f'row_filters."{table}".{new}[{i}]') for i, p in enumerate(lists.get(new, lists.get(old, []))))  # noqa: B023, E731
        filters[table.lower()] = RowFilter(pick("retain", "include_any"), pick("delete", "exclude_any"))
    cases: dict[str, dict[str, tuple[Case, ...]]] = {}
    for table, columns in _tables(raw, "column_cases"):
        cases[table.lower()] = {column.lower(): tuple(_case(c, f'column_cases."{table}".{column}[{i}]') for i, c in enumerate(listed)) for column, listed in columns.items()}
    sensitive = {}
    for table, columns in raw.get("sensitive_columns", {}).items():
        if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
            raise PolicyError(f'sensitive_columns."{table}" must be an array of names')
        sensitive[table.lower()] = tuple(c.lower() for c in columns)
    restore = raw.get("pg_restore", {})
    return Policy(raw.get("salt"), rules, filters, cases, sensitive, _scan(raw.get("output_scan", {})), bool(raw.get("keep_original", False)), restore.get("path"), tuple(restore.get("args", ())), source)


def _tables(raw: Mapping[str, Any], section: str) -> Iterator[tuple[str, Mapping[str, Any]]]:
    for table, content in raw.get(section, {}).items():
        if not isinstance(content, Mapping):
            raise PolicyError(f'{section}."{table}" must be a table')
        yield table, content


def _case(raw: Any, where: str) -> Case:
    if not isinstance(raw, Mapping) or "strategy" not in raw:
        raise PolicyError(f"{where} must have a strategy")
    when = raw.get("when", {})
    if unknown := set(when) - {"any", "all"}:
        raise PolicyError(f"{where}.when.{min(unknown)} is not an option")
    pick = lambda side: tuple(parse_predicate(p, f"{where}.when.{side}[{i}]") for i, p in enumerate(when.get(side, [])))
    return Case(When(pick("any"), pick("all")), parse_spec(raw["strategy"], f"{where}.strategy"))


def _check_paths(table: str, columns: Mapping[str, Spec]) -> None:
    whole = {c for c in columns if not split_key(c)[1]}
    for key in columns:
        base, path = split_key(key)
        if path and base.lower() in whole:
            raise PolicyError(f'rules."{table}": {key} is a path inside {base}, which has a rule for the whole column; keep one of them')


# -- secrets ------------------------------------------------------------------------------------------------------------


def resolve_secrets(raw: Any, where: str = "") -> Any:
    """Every ``${NAME}``, ``${env:NAME}`` and ``${file:/path}`` in strings replaced; a salt without any gives a warning."""
    if isinstance(raw, Mapping):
        return {k: resolve_secrets(v, f"{where}.{k}" if where else k) for k, v in raw.items()}
    if isinstance(raw, list):
        return [resolve_secrets(v, f"{where}[{i}]") for i, v in enumerate(raw)]
    if not isinstance(raw, str):
        return raw
    if "${" not in raw:
        if where.rpartition(".")[2].lower() == "salt":
            warnings.warn(f"{where} holds a plain secret; refer to one with ${{env:NAME}} or ${{file:/path}}", stacklevel=2)
        return raw
    out, rest = "", raw
    while "${" in rest:
        before, _, rest = rest.partition("${")
        name, closed, rest = rest.partition("}")
        if not closed:
            raise PolicyError(f"{where}: a secret reference is not closed in {raw!r}")
        out += before + _secret(name.strip(), where)
    return out + rest


def _secret(name: str, where: str) -> str:
    provider, colon, key = name.partition(":")
    provider, key = (provider.strip(), key.strip()) if colon else ("env", name)
    if not key:
        raise PolicyError(f"{where}: an empty secret reference")
    if provider == "env":
        if key not in os.environ:
            raise PolicyError(f"{where}: environment variable {key} is not set")
        return os.environ[key]
    if provider == "file":
        try:
            value = Path(key).read_text(encoding="utf-8").rstrip("\r\n")
        except (OSError, UnicodeDecodeError) as bad:
            raise PolicyError(f"{where}: secret file {key} can't be read: {bad}") from None
        if not value:
            raise PolicyError(f"{where}: secret file {key} is empty")
        return value
    raise PolicyError(f"{where}: secret provider {provider!r} is unknown; known are env, file")


# -- loading ------------------------------------------------------------------------------------------------------------


def loads(text: str, source: str | None = None) -> Policy:
    try:
        return build(tomllib.loads(text), source)
    except tomllib.TOMLDecodeError as bad:
        raise PolicyError(f"{source or 'policy'}: {bad}") from None


def load(path: str | os.PathLike | None = None, *, folder: str | os.PathLike = ".", allow_none: bool = False) -> Policy:
    """``path``, or else the policy file of ``folder``, or else the tool table of its pyproject.toml; without any an error."""
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
        raw = tomllib.loads(text)
        if Path(path).name == "pyproject.toml":
            raw = raw.get("tool", {}).get(TOOL_TABLE, {})
        return build(raw, str(path))
    own, project = Path(folder, CONFIG_NAME), Path(folder, "pyproject.toml")
    if own.exists():
        return loads(own.read_text(encoding="utf-8"), str(own))
    if project.exists():
        raw = tomllib.loads(project.read_text(encoding="utf-8")).get("tool", {}).get(TOOL_TABLE)
        if raw is not None:
            return build(raw, str(project))
    if allow_none:
        return Policy()
    raise PolicyError(f"no policy was found; looked at {own} and [tool.{TOOL_TABLE}] of {project}")
