"""Which columns look sensitive, and whether the policy covers them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.plans.policy import Policy, Spec, ascii_lower

#: Strategy: what a column's name must contain, or with ``=`` be, or with ``$`` end with. Fixed values, the first that fits counts.
NAMES = (
    ("email", ("email",)),
    ("first_name", ("first_name", "=fname", "given_name")),
    ("last_name", ("last_name", "surname", "=lname", "family_name")),
    ("name", ("name",)),
    ("phone", ("phone", "mobile", "cell")),
    ("redact", ("<address>",)),
    ("hash", ("password", "=pass", "secret", "token", "api_key", "apikey", "ssn", "credit_card", "card_number", "iban", "routing", "account_number")),
    ("date_fuzz", ("=dob", "date_of_birth", "birth_date")),
    ("datetime_fuzz", ("datetime", "timestamp", "$_at")),
    ("time_fuzz", ("time",)),
    ("date_fuzz", ("date",)),
)
#: As a regular expression: what makes a name an address's, and what rules that out.
ADDRESS = "address|street|postal|postcode|mailing|shipping|billing|zip.*code|code.*zip|_zip$"
NO_ADDRESS = "ip_address|mac_address"


def _pattern(marks: Sequence[str]) -> str:
    return "|".join(f"^{m[1:]}$" if m[0] == "=" else f"{m[1:]}$" if m[0] == "$" else m for m in marks if m != "<address>")


def _normal(name: str) -> str:
    return ascii_lower(name).replace("-", "_")


def likely_strategy(column: str) -> str | None:
    """The strategy that a column's name suggests."""
    name = _normal(column)
    for strategy, marks in NAMES:
        if "<address>" in marks:
            if re.search(ADDRESS, name) and not re.search(NO_ADDRESS, name):
                return strategy
        elif re.search(_pattern(marks), name):
            return strategy
    return None


def likely_spec(column: str) -> Spec | None:
    strategy = likely_strategy(column)
    return None if strategy is None else Spec(strategy, as_string=True)


def likely_strategy_column(name: Column) -> Column:
    """The same over a column of names."""
    n = F.replace(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("-"), F.lit("_"))
    out = None
    for strategy, marks in NAMES:
        fits = n.rlike(ADDRESS) & ~n.rlike(NO_ADDRESS) if "<address>" in marks else n.rlike(_pattern(marks))
        out = F.when(fits, strategy) if out is None else out.when(fits, strategy)
    return out


def is_sensitive(policy: Policy, table: str, column: str) -> bool:
    return column.lower() in policy.sensitive(table) or likely_strategy(column) is not None


def is_covered(policy: Policy, table: str, column: str, columns: Iterable[str] = ()) -> bool:
    """Whether a rule, a case or a rule for a path inside it names the column."""
    return policy.rule(table, column) is not None or bool(policy.cases(table, column)) or bool(policy.json_rules(table, column, tuple(columns)))


def coverage(policy: Policy, tables: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Sensitive columns detected, covered and uncovered, as sorted table.column names. ``tables``: columns by table."""
    found = sorted({(f"{t.lower()}.{c.lower()}", is_covered(policy, t, c, columns)) for t, columns in tables.items() for c in columns if is_sensitive(policy, t, c)})
    return {"detected": [n for n, _ in found], "covered": [n for n, ok in found if ok], "uncovered": [n for n, ok in found if not ok]}


def coverage_table(spark: SparkSession, policy: Policy, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """(table, column, strategy, covered) of all sensitive columns; ``strategy`` is what the name suggests."""
    rows = [(t.lower(), c.lower(), c.lower() in policy.sensitive(t), is_covered(policy, t, c, columns)) for t, columns in tables.items() for c in columns]
    listed = spark.createDataFrame(rows, "table string, column string, listed boolean, covered boolean")
    named = listed.withColumn("strategy", likely_strategy_column(F.col("column")))
    return named.where("listed OR strategy IS NOT NULL").select("table", "column", "strategy", "covered")


class Uncovered(Exception):
    """Sensitive columns without a rule."""


def require(policy: Policy, tables: Mapping[str, Sequence[str]]) -> None:
    if missing := coverage(policy, tables)["uncovered"]:
        raise Uncovered("sensitive columns without a rule: " + ", ".join(missing))
