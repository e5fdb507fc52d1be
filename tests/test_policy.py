import warnings

import pytest

from veilwork.plans import policy
from veilwork.plans.lint import lint
from veilwork.plans.policy import PolicyError, loads


def test_precedence_and_fail_closed(tmp_path):
    with pytest.raises(PolicyError, match="no policy was found"):
        policy.load(folder=tmp_path)
    assert policy.load(folder=tmp_path, allow_none=True).is_empty
    (tmp_path / "pyproject.toml").write_text('[tool.veilwork.rules.t]\na = { strategy = "null" }')
    assert policy.load(folder=tmp_path).rule("t", "A").strategy == "null"
    (tmp_path / ".veilwork.toml").write_text('[rules.t]\na = { strategy = "redact" }')
    assert policy.load(folder=tmp_path).rule("t", "a").strategy == "redact"
    (tmp_path / "x.toml").write_text('[rules.t]\na = { strategy = "blank" }')
    assert policy.load(tmp_path / "x.toml", folder=tmp_path).rule("t", "a").strategy == "blank"


@pytest.mark.parametrize(
    "spec, said",
    [
        ('strategy = "nope"', "unknown"),
        ('strategy = "hash", domain = " "', "domain is empty"),
        ('strategy = "hash", unique_within_domain = true', "needs a domain"),
        ('strategy = "redact", domain = "d"', "can't be used with redact"),
        ('strategy = "email", salt = "x"', "salt can't be used"),
        ('strategy = "hash", min = 1', "min can't be used"),
        ('strategy = "uuid", length = 3', "length can't be used"),
        ('strategy = "int_range", min = 5, max = 1', "must not exceed"),
        ('strategy = "decimal", scale = 39', "between 0 and 38"),
        ('strategy = "payment_card", length = 12', "between 13 and 19"),
        ('strategy = "string", length = 0', "1 or more"),
        ('strategy = "date_fuzz", min_days = 3, max_days = 1', "must not exceed"),
        ('strategy = "date_fuzz", min_seconds = 3', "min_seconds can't be used"),
        ('strategy = "phone", locale = "xx"', "locale 'xx' is unknown"),
        ('strategy = "faker"', "faker is missing"),
        ('strategy = "faker", faker = "name"', "module::Type"),
        ('strategy = "faker", faker = "name::Nope"', "not a supported"),
        ('strategy = "faker", faker = "number::NumberWithFormat"', "lacks an option"),
        ('strategy = "hash", extra = 1', "not an option"),
        ('strategy = "int_range", min = "1"', "must be an integer"),
    ],
)
def test_bad_specs_name_their_place(spec, said):
    with pytest.raises(PolicyError) as bad:
        loads(f'[rules."public.users"]\nemail = {{ {spec} }}')
    assert said in str(bad.value) and 'rules."public.users".email' in str(bad.value)


def test_bad_predicates_and_sections():
    with pytest.raises(PolicyError, match="op 'almost' is unknown"):
        loads('[row_filters.t]\nretain = [{ column = "a", op = "almost" }]')
    with pytest.raises(PolicyError, match="not a regular expression"):
        loads('[row_filters.t]\nretain = [{ column = "a", op = "regex", value = "(" }]')
    with pytest.raises(PolicyError, match="no longer supported"):
        loads("[table_options.t]\nauto = true")
    with pytest.raises(PolicyError, match="not a section"):
        loads("[rulez.t]")
    with pytest.raises(PolicyError, match="a path inside payload"):
        loads('[rules.t]\npayload = { strategy = "null" }\n"payload.a" = { strategy = "null" }')


def test_secrets(monkeypatch, tmp_path):
    monkeypatch.setenv("SALT_A", "one")
    (tmp_path / "s").write_text("two\n\n")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        p = loads(f'salt = "<${{SALT_A}}-${{env:SALT_A}}-${{file:{tmp_path}/s}}>"')
    assert p.salt == "<one-one-two>"
    for text, said in (("${NOT_SET_X}", "NOT_SET_X is not set"), ("${}", "empty"), ("${env:}", "empty"), ("${vault:x}", "unknown"), ("${A", "not closed"), ("${file:/no/such}", "can't be read")):
        with pytest.raises(PolicyError, match=said):
            loads(f'salt = "{text}"')
    with pytest.warns(UserWarning, match="plain secret"):
        loads('salt = "plain"')


def test_lookups_prefer_the_qualified_table():
    p = loads('[rules.users]\na = { strategy = "null" }\nb = { strategy = "blank" }\n[rules."Public.Users"]\nA = { strategy = "redact" }\n[sensitive_columns]\nusers = ["x"]\n"public.users" = ["y"]')
    assert p.rule("public.users", "a").strategy == "redact" and p.rule("PUBLIC.users", "B").strategy == "blank" and p.rule("users", "a").strategy == "null"
    assert p.sensitive("public.users") == ("y",) and p.sensitive("other.users") == ("x",)


def test_json_rules():
    p = loads('[rules.t]\n"Payload.userEmail" = { strategy = "null" }\n"payload__a__b" = { strategy = "blank" }\n[rules."s.t"]\n"payload.a.b" = { strategy = "redact" }')
    assert [(path, s.strategy) for path, s in p.json_rules("s.t", "payload")] == [(("a", "b"), "redact"), (("userEmail",), "null")]
    assert policy.split_key("a__b") == ("a", ("b",)) and policy.split_key("a.b__c") == ("a.b", ("c",)) and policy.split_key("plain") == ("plain", ())
    named = loads('[rules.t]\n"a__b" = { strategy = "null" }')
    assert named.json_rules("t", "a", ("a__b",)) == [] and named.rule("t", "a__b").strategy == "null"


def test_lint():
    p = loads(
        '[rules.empty]\n[rules.t]\na = { strategy = "hash" }\nb = { strategy = "email", domain = "D " }\nc = { strategy = "name", domain = "d" }\n'
        '[column_cases.u]\n[sensitive_columns]\nt = ["a", "missing"]\n"s.t" = ["b"]'
    )
    codes = [(v.code, v.severity) for v in lint(p)]
    assert codes == [("empty-rules-table", "warning"), ("empty-column-cases-table", "warning"), ("unsalted-hash", "warning"), ("inconsistent-domain-strategy", "error"), ("uncovered-sensitive-column", "error")]
    assert lint(loads("")) == []
