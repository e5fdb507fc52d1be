"""Checks of a policy without data."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from veilwork.plans.policy import Policy


@dataclass(frozen=True)
class Violation:
    code: str
    severity: str
    where: str
    message: str

    def __str__(self) -> str:
        return f"{self.severity} [{self.code}] {self.where}: {self.message}"


def lint(policy: Policy) -> list[Violation]:
    from veilwork.operators.coverage import is_covered

    out = [Violation("empty-rules-table", "warning", f'rules."{t}"', "has no rules") for t, columns in sorted(policy.rules.items()) if not columns]
    out += [Violation("empty-column-cases-table", "warning", f'column_cases."{t}"', "has no cases") for t, columns in sorted(policy.column_cases.items()) if not columns or not any(columns.values())]
    by_domain: dict[str, set[str]] = defaultdict(set)
    for table, column, spec in policy.specs():
        if spec.strategy == "hash" and not spec.salt and not policy.salt:
            out.append(Violation("unsalted-hash", "warning", f"{table}.{column}", "hashes without a salt, so values that are few can be guessed"))
        if spec.domain:
            by_domain[spec.domain_key].add(spec.strategy)
    out += [Violation("inconsistent-domain-strategy", "error", f"domain {d!r}", "is used with different strategies: " + ", ".join(sorted(s))) for d, s in sorted(by_domain.items()) if len(s) > 1]
    for table, columns in sorted(policy.sensitive_columns.items()):
        out += [Violation("uncovered-sensitive-column", "error", f"{table}.{c}", "is listed as sensitive and has no rule") for c in columns if not is_covered(policy, table, c)]
    return out
