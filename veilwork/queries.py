"""Queries of the masking engine over the sample tables, each with the SQL that gives the same rows.

Every query applies an operator to whole tables. The SQL spells out what the operator means, down to the draws of a
domain's byte stream. Values that are random by nature (masks without a domain, other than hashes) have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import fakes
from veilwork.functions.stream import TAG, _pads, le64
from veilwork.operators import coverage, report, scan, scaffold, storage
from veilwork.operators.masking import Masking
from veilwork.plans import policy
from veilwork.sources import sqldump
from veilwork.streaming import masking as streams

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masking(toml: str, **more) -> Masking:
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the salts here are public
        return Masking.of(policy.loads(toml), **more)


def masked(name: str, source: str, toml: str, columns: list[str], sql: str | None, **more) -> None:
    """Registers a query: ``columns`` (as SQL) of a table, masked by a policy under the table's name."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = masking(toml, **more)
        df = table(spark, sf_dir, source).selectExpr(*columns)
        return m.with_unique({source: df}).apply(df, source) if "unique_within_domain" in toml else m.apply(df, source)

    register(name, query, sql)


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


# -- filters, predicates, cases -------------------------------------------------------------------------------------------

masked(
    "policy_mask_customer", "customer",
    '''salt = "s4lt"
[rules.customer]
c_name = { strategy = "hash" }
[row_filters.customer]
retain = [{ column = "c_mktsegment", op = "eq", value = "BUILDING" }]''',
    ["c_custkey", "c_name", "c_mktsegment"],
    "SELECT c_custkey, sha256('s4lt' || c_name) AS c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
)
masked(
    "filter_retain_delete", "customer",
    '''[row_filters.customer]
retain = [{ column = "c_mktsegment", op = "in", values = ["BUILDING", "MACHINERY"] }, { column = "c_nationkey", op = "eq", value = 7 }]
delete = [{ column = "c_nationkey", op = "in", values = ["1", "2"] }, { column = "c_mktsegment", op = "eq", value = "machinery" , case_insensitive = true }]''',
    ["c_custkey", "c_nationkey", "c_mktsegment"],
    "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey = 7) AND NOT (c_nationkey IN (1, 2) OR lower(c_mktsegment) = 'machinery')",
)


def _filtered(name: str, source: str, predicates: str, columns: list[str], where: str, select: str | None = None) -> None:
    masked(name, source, f"[row_filters.{source}]\nretain = [{predicates}]", columns, f"SELECT * FROM (SELECT {select or ', '.join(columns)} FROM {source}) WHERE {where}")


_NULLED = ["o_orderkey", "nullif(o_orderpriority, '1-URGENT') AS priority"]
_filtered("filter_neq_null", "orders", '{ column = "priority", op = "neq", value = "2-HIGH" }', _NULLED, "priority IS DISTINCT FROM '2-HIGH'")
_filtered("filter_not_in", "orders", '{ column = "priority", op = "not_in", values = ["2-HIGH", "3-MEDIUM"] }', _NULLED, "priority IS NULL OR priority NOT IN ('2-HIGH', '3-MEDIUM')")
_filtered("filter_is_null", "orders", '{ column = "priority", op = "is_null" }', _NULLED, "priority IS NULL")
_filtered("filter_not_null", "orders", '{ column = "priority", op = "not_null" }', _NULLED, "priority IS NOT NULL")
_filtered("filter_like", "part", '{ column = "p_type", op = "like", value = "%CO_OM%" }', ["p_partkey", "p_type"], "p_type LIKE '%CO_OM%'")
_filtered("filter_ilike", "part", '{ column = "p_name", op = "ilike", value = "%E_ %R" }', ["p_partkey", "p_name"], "p_name ILIKE '%E_ %R'")
_filtered("filter_regex", "supplier", '{ column = "s_name", op = "regex", value = "[0-9]*[05]$" }', ["s_suppkey", "s_name"], "regexp_matches(s_name, '[0-9]*[05]$')")
_filtered("filter_iregex", "supplier", '{ column = "s_name", op = "iregex", value = "^SUPP.*[1-3]$" }', ["s_suppkey", "s_name"], "regexp_matches(s_name, '^SUPP.*[1-3]$', 'i')")
_filtered("filter_numeric", "lineitem", '{ column = "l_quantity", op = "gte", value = 49 }, { column = "l_linenumber", op = "lt", value = "2" }', ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 49 OR l_linenumber < 2")
_filtered("filter_numeric_strict", "orders", '{ column = "key", op = "gt", value = "100.5" }, { column = "key", op = "lte", value = 7 }', ["o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderkey, ' ') ELSE cast(o_orderkey AS string) END AS key"], "key NOT LIKE '% ' AND (CAST(key AS DOUBLE) > 100.5 OR CAST(key AS DOUBLE) <= 7)", "o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || ' ' ELSE CAST(o_orderkey AS VARCHAR) END AS key")
_filtered("filter_json_path", "events", '{ column = "props.k", op = "gte", value = 50 }, { column = "props__k", op = "eq", value = 7 }', ["event_id", "props"], "CAST(props->>'$.k' AS DOUBLE) >= 50 OR props->>'$.k' = '7'")
masked(
    "filter_json_missing", "events",
    '''[row_filters.events]
delete = [{ column = "props.nothing.here", op = "is_null" }]
retain = [{ column = "no_such_column", op = "neq", value = "x" }, { column = "event_type", op = "not_null" }]''',
    ["event_id"], "SELECT event_id FROM events WHERE false",
)
masked(
    "column_case_first_match", "customer",
    '''[rules.customer]
c_name = { strategy = "hash" }
[[column_cases.customer.c_name]]
when.any = [{ column = "c_mktsegment", op = "eq", value = "BUILDING" }]
strategy = { strategy = "redact" }
[[column_cases.customer.c_name]]
when.all = [{ column = "c_nationkey", op = "lt", value = 10 }, { column = "c_mktsegment", op = "neq", value = "MACHINERY" }]
strategy = { strategy = "hash", salt = "other" }''',
    ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'REDACTED' WHEN c_nationkey < 10 AND c_mktsegment <> 'MACHINERY' THEN sha256('other' || c_name) ELSE sha256(c_name) END AS c_name, c_nationkey, c_mktsegment FROM customer",
)

# -- constants, hashes ----------------------------------------------------------------------------------------------------

_NULLABLE = ["c_custkey", "nullif(c_name, concat('Customer#', lpad(cast(c_custkey AS string), 9, '0'))) AS same", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name"]
for _name, _value in {"null": "CAST(NULL AS VARCHAR)", "redact": "'REDACTED'", "blank": "CASE WHEN name IS NOT NULL THEN '' END", "empty_array": "CASE WHEN name IS NOT NULL THEN '[]' END", "empty_object": "CASE WHEN name IS NOT NULL THEN '{}' END"}.items():
    masked(f"strat_{_name}", "customer", f'[rules.customer]\nname = {{ strategy = "{_name}" }}', ["c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name"], f"SELECT c_custkey, {_value} AS name FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer)")
masked("strat_hash_salted", "customer", 'salt = "global"\n[rules.customer]\nname = { strategy = "hash", salt = "own" }\nc_mktsegment = { strategy = "hash" }', ["c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name", "c_mktsegment"], "SELECT c_custkey, sha256('own' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END) AS name, sha256('global' || c_mktsegment) AS c_mktsegment FROM customer")


def _hmac_sql(key: str, message: str) -> str:
    inner, outer = (p.hex() for p in _pads(key.encode()))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || {message})))"


masked("strat_hash_hmac", "customer", 'salt = "a key"\n[rules.customer]\nc_name = { strategy = "hash" }', ["c_custkey", "c_name"], f"SELECT c_custkey, {_hmac_sql('a key', 'encode(c_name)')} AS c_name FROM customer", hardened=True)
masked("truncate_hash", "part", '[rules.part]\np_name = { strategy = "hash" }', ["p_partkey", "p_name"], "SELECT p_partkey, left(sha256(p_name), 10) AS p_name FROM part")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masking('[rules.part]\np_name = { strategy = "hash" }', lengths={"part": {"p_name": 10}})
    return m.apply(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "part")


QUERIES["truncate_hash"] = _truncated

# -- domains --------------------------------------------------------------------------------------------------------------


def _seed_sql(strategy: str, domain: str, value: str, salt: str = "") -> str:
    return f"from_hex(sha256(encode('{TAG.decode()}{salt}{strategy}{domain}' || {value}) || from_hex('{le64(0).hex()}')))"


def _blocks_sql(n: int) -> str:
    return ", ".join(f"sha256(seed || from_hex('{le64(i).hex()}')) AS b{i}" for i in range(n))


def _draw(j: int, span: int) -> str:
    places = [16 * (j % 4) + 2 * i + 1 for i in range(7, -1, -1)]
    return f"CAST(CAST('0x' || {' || '.join(f'b{j // 4}[{p}:{p + 1}]' for p in places)} AS UBIGINT) % {span} AS BIGINT)"


def _pick(j: int, words: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(w) for w in words)}][{_draw(j, len(words))} + 1]"


def domain(name: str, source: str, key: str, value: str, spec: str, strategy: str, drawn: str, draws: int, extra: str = "") -> None:
    """A query that masks ``value`` (SQL in both dialects) as ``v`` in domain ``ids``; ``drawn``: the value in SQL, from b0, b1, ..."""
    masked(
        name, source, f'[rules.{source}]\nv = {{ strategy = "{strategy}", domain = " IDS"{spec} }}', [key, f"{value} AS v"],
        f"WITH a AS (SELECT {key}, {value} AS v FROM {source}), s AS (SELECT *, {_seed_sql(strategy, 'ids', 'v')} AS seed FROM a), d AS (SELECT *, {_blocks_sql(-(-draws // 4))} FROM s) SELECT {key}, {drawn} AS v FROM d",
    )


_UUID = "b0[1:8] || '-' || b0[9:12] || '-4' || b0[14:16] || '-' || '89ab'[CAST('0x' || b0[17:17] AS INT) % 4 + 1] || b0[18:20] || '-' || b0[21:32]"
_DIGITS = [f"CAST({_draw(i, 10)} AS VARCHAR)" for i in range(32)]
_CARD = " || ".join([f"CAST({_draw(0, 9)} + 1 AS VARCHAR)", *_DIGITS[1:15]])
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
domain("domain_uuid", "customer", "c_custkey", "c_name", "", "uuid", _UUID, 2)
domain("domain_int_range", "customer", "c_custkey", "c_name", ", min = 18, max = 90", "int_range", f"18 + {_draw(0, 73)}", 1)
domain("domain_decimal", "orders", "o_orderkey", "o_orderpriority || o_orderkey", ", min = -5, max = 9999, scale = 3", "decimal", f"CAST(-5 + {_draw(0, 10005)} AS VARCHAR) || '.' || {' || '.join(_DIGITS[1:4])}", 4)
domain("domain_string", "customer", "c_custkey", "c_name", ", length = 10", "string", "lower(" + " || ".join(f"'{_ALNUM}'[{_draw(i, 62)} + 1]" for i in range(10)) + ")", 10)
domain(
    "domain_payment_card", "customer", "c_custkey", "c_name", "", "payment_card",
    f"({_CARD}) || CAST((10 - list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(({_CARD})[i] AS INT) WHEN CAST(({_CARD})[i] AS INT) < 5 THEN 2 * CAST(({_CARD})[i] AS INT) ELSE 2 * CAST(({_CARD})[i] AS INT) - 9 END)) % 10) % 10 AS VARCHAR)", 15,
)
domain("domain_date_fuzz", "orders", "o_orderkey", "left(cast(o_orderdate AS VARCHAR(40)), 10)", "", "date_fuzz", f"CAST(CAST(CAST(v AS DATE) + CAST({_draw(0, 61)} - 30 AS INT) AS DATE) AS VARCHAR)", 1)
_SECONDS = f"(CAST(v[1:2] AS BIGINT) * 3600 + CAST(v[4:5] AS BIGINT) * 60 + CAST(v[7:8] AS BIGINT) + {_draw(0, 601)} - 300 + 86400) % 86400"
_CLOCK = f"TIMESTAMP '2000-01-01' + to_seconds({_SECONDS})"
domain("domain_time_fuzz", "events", "event_id", "substr(cast(ts AS VARCHAR(40)), 12, 8)", "", "time_fuzz", f"CASE WHEN CAST(v[7:8] AS INT) > 0 OR ({_SECONDS}) % 60 > 0 THEN strftime({_CLOCK}, '%H:%M:%S') ELSE strftime({_CLOCK}, '%H:%M') END", 1)
domain("domain_hash", "customer", "c_custkey", "c_name", "", "hash", f"sha256(encode('{TAG.decode()}ids' || v) || from_hex('{le64(0).hex()}'))", 1)
_WORDS = [p for p in fakes._USER.parts if isinstance(p, fakes.Pick)]
_EMAIL = f"{_pick(0, _WORDS[0].words)} || {_pick(1, _WORDS[1].words)} || {_pick(2, _WORDS[2].words)} || CAST(1 + {_draw(3, 9999)} AS VARCHAR) || '@' || {_pick(4, fakes._DOMAIN.words)}"
domain("domain_email", "customer", "c_custkey", "c_name", "", "email", _EMAIL, 5)
domain("domain_name_german", "customer", "c_custkey", "c_name", ', locale = "de_de"', "name", f"{_pick(0, fakes.first_name('de_de').words)} || ' ' || {_pick(1, fakes.last_name('de_de').words)}", 2)
domain("domain_phone", "customer", "c_custkey", "c_name", "", "phone", f"'(' || CAST({_draw(0, 9)} + 1 AS VARCHAR) || {_DIGITS[1]} || {_DIGITS[2]} || ') ' || CAST({_draw(3, 9)} + 1 AS VARCHAR) || {_DIGITS[4]} || {_DIGITS[5]} || '-' || {' || '.join(_DIGITS[6:10])}", 10)
domain("domain_faker_semver", "part", "p_partkey", "p_name", ', faker = "filesystem::Semver"', "faker", f"{_draw(0, 10)} || '.' || {_draw(1, 21)} || '.' || {_draw(2, 21)}", 3)
masked(
    "domain_datetime_fuzz_typed", "orders", '[rules.orders]\no_orderdate = { strategy = "datetime_fuzz", domain = "ids" }', ["o_orderkey", "o_orderdate"],
    f"WITH s AS (SELECT *, {_seed_sql('datetime_fuzz', 'ids', 'CAST(o_orderdate AS VARCHAR)')} AS seed FROM orders), d AS (SELECT *, {_blocks_sql(1)} FROM s) SELECT o_orderkey, CAST(o_orderdate + to_seconds({_draw(0, 172801)} - 86400) AS TIMESTAMP) AS o_orderdate FROM d",
)


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked keys still join: orders by their customers' segment, over the masked key."""
    m = masking('[rules.customer]\nc_custkey = { strategy = "uuid", domain = "key" }\n[rules.orders]\no_custkey = { strategy = "uuid", domain = "key" }')
    customers = m.apply(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "customer")
    orders = m.apply(table(spark, sf_dir, "orders").select("o_custkey"), "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"))


register("domain_fk_join_preserved", _joined, "SELECT c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique pseudonyms out of a space hardly larger than the values, over two tables: as many pseudonyms as values."""
    spec = '{ strategy = "int_range", min = 1, max = 3000000, domain = "key", unique_within_domain = true }'
    m = masking(f"[rules.customer]\nc_custkey = {spec}\n[rules.orders]\no_custkey = {spec}")
    tables = {"customer": table(spark, sf_dir, "customer").select("c_custkey"), "orders": table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 > 0, F.col("o_custkey")).alias("o_custkey"))}
    m = m.with_unique(tables)
    both = m.apply(tables["customer"], "customer").toDF("key").union(m.apply(tables["orders"], "orders").toDF("key"))
    return both.agg(F.countDistinct("key").alias("pseudonyms"), F.count_if(F.col("key").isNull()).alias("nulls"), F.count(F.lit(1)).alias("all_rows"))


register(
    "unique_domain", _unique,
    "WITH k AS (SELECT c_custkey AS key FROM customer UNION ALL SELECT CASE WHEN o_orderkey % 10 > 0 THEN o_custkey END FROM orders) SELECT count(DISTINCT key) AS pseudonyms, count(*) FILTER (WHERE key IS NULL) AS nulls, count(*) AS all_rows FROM k",
)
masked("unique_domain_mapping", "customer", '[rules.customer]\nc_name = { strategy = "email", domain = "people", unique_within_domain = true }', ["c_custkey", "c_name"], None)

# -- random values: shape only --------------------------------------------------------------------------------------------

_RANDOM = "\n".join(f"v{i} = {{ strategy = {s} }}" for i, s in enumerate(['"uuid"', '"int_range", min = 5, max = 9', '"decimal"', '"payment_card", length = 15', '"string"', '"email"', '"name", locale = "ja_jp"', '"phone"', '"date_fuzz"', '"datetime_fuzz"']))
masked("random_strategies", "orders", f"[rules.orders]\n{_RANDOM}", ["o_orderkey", *(f"o_orderpriority AS v{i}" for i in range(8)), "cast(cast(o_orderdate AS date) AS string) AS v8", "cast(o_orderdate AS string) AS v9"], None, seed=7)


def _random_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random masks have their strategies' shapes, every one of them."""
    got = QUERIES["random_strategies"](spark, sf_dir)
    shapes = {"v0": "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$", "v1": "^[5-9]$", "v2": r"^[0-9]{1,7}\.[0-9]{2}$", "v3": "^[1-9][0-9]{14}$", "v4": "^[a-z0-9]{12}$", "v5": r"^[a-z0-9_.-]+@example\.(com|org|net)$", "v6": "^.{2,3} .{1,3}$", "v7": r"^\([1-9][0-9]{2}\) [1-9][0-9]{2}-[0-9]{4}$", "v8": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "v9": "^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:]{8}$"}
    good = [F.count_if(F.col(c).rlike(p)).alias(c) for c, p in shapes.items()]
    return got.agg(*good, F.count_if(F.call_function("luhn_check", F.col("v3"))).alias("luhn"), (F.countDistinct("v0") == F.count(F.lit(1))).alias("uuids_differ"))


register("random_shapes", _random_shapes, "SELECT " + ", ".join(f"count(*) AS v{i}" for i in range(10)) + ", count(*) AS luhn, true AS uuids_differ FROM orders")


# -- JSON -----------------------------------------------------------------------------------------------------------------

masked(
    "json_rewrite_keep_types", "events", '[rules.events]\n"props.k" = { strategy = "int_range", min = 100, max = 199, domain = "ids" }\n"props.missing" = { strategy = "redact" }', ["event_id", "props"],
    f"WITH s AS (SELECT event_id, {_seed_sql('int_range', 'ids', '''(props->>'$.k')''')} AS seed FROM events), d AS (SELECT *, {_blocks_sql(1)} FROM s) SELECT event_id, '{{\"k\":' || (100 + {_draw(0, 100)}) || '}}' AS props FROM d",
)
masked(
    "json_rewrite_nested", "events", '[rules.events]\n"doc.groups.members.k" = { strategy = "redact" }\n"doc.groups.1.label" = { strategy = "null" }',
    ["event_id", """concat('{"groups": [{"members": [', props, ', ', props, ']}, {"label": "', event_type, '"}]}') AS doc"""],
    """SELECT event_id, '{"groups":[{"members":[{"k":"REDACTED"},{"k":"REDACTED"}]},{"label":null}]}' AS doc FROM events""",
)
_filtered(
    "filter_json_fan_out", "events", '{ column = "doc.items.kind", op = "eq", value = "click" }', ["event_id", """concat('{"items": [{"kind": "', event_type, '"}, [{"kind": "', reverse(event_type), '"}]]}') AS doc"""],
    """doc LIKE '%"click"%'""", """event_id, '{"items": [{"kind": "' || event_type || '"}, [{"kind": "' || reverse(event_type) || '"}]]}' AS doc""",
)

# -- scan -----------------------------------------------------------------------------------------------------------------


def _spans_sql(source: str, key: str, column: str, category: str, k: int = 0) -> str:
    p = scan.PATTERNS[category][k].replace("'", "''")
    return rf"SELECT {key} AS key, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s, unnest(m) AS x FROM (SELECT {key}, regexp_extract_all({column}, '{p}') AS m, string_split_regex({column}, '{p}') AS g FROM {source})"


_LUHN_SQL = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) WHEN CAST(d[i] AS INT) < 5 THEN 2 * CAST(d[i] AS INT) ELSE 2 * CAST(d[i] AS INT) - 9 END)) % 10 = 0"
_VALID_SQL = {
    "email": "true",
    "ssn": "length(d) = 9 AND d[1:3] NOT IN ('000', '666') AND d[1:1] <> '9' AND d[4:5] <> '00' AND d[6:9] <> '0000'",
    "pan": f"length(d) BETWEEN 13 AND 19 AND {_LUHN_SQL}",
}


def _found_sql(source: str, key: str, column: str, category: str) -> str:
    """(key, s, e, x) of a category's matches; s from 0, e exclusive."""
    if category != "token":
        return f"SELECT key, s, s + length(x) AS e, x FROM (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS d FROM ({_spans_sql(source, key, column, category)})) WHERE {_VALID_SQL[category]}"
    every = " UNION ALL ".join(f"SELECT key, {k} AS k, s, s + length(x) AS e, x FROM ({_spans_sql(source, key, column, 'token', k)})" for k in range(len(scan.PATTERNS["token"])))
    return f"SELECT key, s, e, x FROM (WITH t AS ({every}) SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.key = t.key AND o.k < t.k AND o.s < t.e AND t.s < o.e))"


def _finding(category: str, source: str, key: str, column: str) -> None:
    settings = policy.ScanSettings(enabled_categories=(category,))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.findings(table(spark, sf_dir, source), [column], settings, key=F.col(key)).select(F.col("row").alias(key), "start", "end", "snippet")

    register(f"scan_{category}_{source}", query, f'SELECT key AS {key}, CAST(s + 1 AS INT) AS start, CAST(e + 1 AS INT) AS "end", x AS snippet FROM ({_found_sql(source, key, column, category)})')


for _category in policy.CATEGORIES:
    _finding(_category, "documents", "doc_id", "text")
_finding("email", "pages", "page_id", "html")


def _ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's key as a social security number, sound or not."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("concat('no. ', lpad(cast(o_orderkey * 7919 % 1000 AS string), 3, '0'), '-', lpad(cast(o_orderkey % 100 AS string), 2, '0'), '-', lpad(cast(o_orderkey * 31 % 10000 AS string), 4, '0'), '.') AS t"))
    return df.where(F.size(scan.found(F.col("t"), "ssn")) > 0)


_SSN_TEXT = "'no. ' || lpad(CAST(o_orderkey * 7919 % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey * 31 % 10000 AS VARCHAR), 4, '0') || '.'"
register("scan_ssn_validity", _ssn, f"SELECT o_orderkey, t FROM (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d FROM (SELECT o_orderkey, {_SSN_TEXT} AS t FROM orders)) WHERE {_VALID_SQL['ssn']}")

_GATE = policy.ScanSettings(fail_on_severity="high", thresholds={"email": 5}, severities={"pan": "critical", "token": "medium"})


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.gate(scan.category_counts(table(spark, sf_dir, "documents"), ["text"], _GATE), _GATE)


register(
    "scan_gate", _gate,
    "SELECT category, severity, count, threshold, count > threshold AND severity IN ('high', 'critical') AS failed FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS category, '{_GATE.severity(c)}' AS severity, (SELECT count(*) FROM ({_found_sql('documents', 'doc_id', 'text', c)})) AS count, CAST({_GATE.threshold(c)} AS BIGINT) AS threshold" for c in policy.CATEGORIES) + ")",
)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = policy.ScanSettings(enabled_categories=("email", "token"))
    return scan.samples(scan.findings(table(spark, sf_dir, "documents"), ["text"], settings, key=F.col("doc_id")), settings)


register(
    "scan_samples", _samples,
    " UNION ALL ".join(f"SELECT * FROM (SELECT key AS row, 'text' AS column, '{c}' AS category, CAST(s + 1 AS INT) AS start, CAST(e + 1 AS INT) AS \"end\", x AS snippet FROM ({_found_sql('documents', 'doc_id', 'text', c)}) ORDER BY key, s LIMIT 5)" for c in ("email", "token")),
)

# -- coverage, scaffold, report, dumps, streams ---------------------------------------------------------------------------

_COVERED = '[rules.customer]\nc_name = { strategy = "name" }\n[rules.events]\n"props.k" = { strategy = "null" }\n[sensitive_columns]\nevents = ["props", "user_id"]'


def _columns(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {t: table(spark, sf_dir, t).columns for t in TABLES}


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.coverage_table(spark, policy.loads(_COVERED), _columns(spark, sf_dir))


def _scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = scaffold.by_names(_columns(spark, sf_dir))
    return spark.createDataFrame([(t, c, s.strategy) for t, own in rules.items() for c, s in own.items()], "table string, column string, strategy string")


def _likely_sql(n: str) -> str:
    def fits(marks: tuple[str, ...]) -> str:
        if "<address>" in marks:
            return f"(regexp_matches({n}, '{coverage.ADDRESS}') AND NOT regexp_matches({n}, '{coverage.NO_ADDRESS}'))"
        return " OR ".join(f"{n} = '{m[1:]}'" if m[0] == "=" else f"suffix({n}, '{m[1:]}')" if m[0] == "$" else f"contains({n}, '{m}')" for m in marks)

    return "CASE " + " ".join(f"WHEN {fits(marks)} THEN '{s}'" for s, marks in coverage.NAMES) + " END"


_COLUMNS_SQL = f"SELECT DISTINCT table_name AS \"table\", lower(column_name) AS \"column\", {_likely_sql('lower(column_name)')} AS strategy FROM information_schema.columns WHERE table_name IN ({', '.join(map(repr, TABLES))})"
register("coverage_summary", _coverage, f"SELECT \"table\", \"column\", strategy, (\"table\" = 'customer' AND \"column\" = 'c_name') OR (\"table\" = 'events' AND \"column\" = 'props') AS covered FROM ({_COLUMNS_SQL}) WHERE strategy IS NOT NULL OR (\"table\" = 'events' AND \"column\" IN ('props', 'user_id'))")
register("scaffold_rules", _scaffold, f'SELECT "table", "column", strategy FROM ({_COLUMNS_SQL}) WHERE strategy IS NOT NULL')

_REPORTED = '''salt = "s"
[rules.orders]
o_orderpriority = { strategy = "redact" }
[row_filters.orders]
delete = [{ column = "o_orderstatus", op = "eq", value = "F" }]
[[column_cases.orders.o_totalprice]]
when.any = [{ column = "o_totalprice", op = "gt", value = 100000 }]
strategy = { strategy = "null" }'''


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(masking(_REPORTED), table(spark, sf_dir, "orders"), "orders")


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cells_changed(masking(_REPORTED), table(spark, sf_dir, "orders"), "orders")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.events(masking(_REPORTED), table(spark, sf_dir, "orders"), "orders").groupBy("type", "column", "strategy", "original_was_null").agg(F.count(F.lit(1)).alias("n"))


register("report_counts", _counts, "SELECT 'orders' AS \"table\", count(*) AS rows_processed, count(*) FILTER (WHERE o_orderstatus = 'F') AS rows_dropped, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END) AS BIGINT) AS cells_targeted FROM orders")
register("report_cells_changed", _changed, "SELECT 'orders' AS \"table\", CAST(sum(CASE WHEN o_totalprice > 100000 THEN 2 ELSE 1 END) AS BIGINT) AS cells_changed FROM orders WHERE o_orderstatus <> 'F'")
register(
    "report_events", _events,
    "SELECT type, \"column\", strategy, was AS original_was_null, count(*) AS n FROM (SELECT 'RowDropped' AS type, NULL::VARCHAR AS \"column\", NULL::VARCHAR AS strategy, NULL::BOOLEAN AS was FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'CellChanged', 'o_orderpriority', 'redact', false FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'CellChanged', 'o_totalprice', 'null', false FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000) GROUP BY ALL",
)


def _copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sqldump.copy_encoded(F.col("text")).alias("text"))


_ESCAPED = reduce(lambda s, c: f"replace({s}, chr({ord(c[0])}), '{c[1]}')", [("\\", "\\\\"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v")], "text")
register("copy_escape_text", _copy_text, f"SELECT doc_id, {_ESCAPED} AS text FROM documents")


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a COPY block of a dump, read back through the data source."""
    import os
    import uuid

    df = table(spark, sf_dir, "customer").select(*(F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
    folder = os.path.join(storage.folder(spark).removeprefix("file://"), "dumps")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{uuid.uuid4().hex}.sql")
    lines = df.select(F.array_join(F.array(*(sqldump.copy_encoded(F.col(c)) for c in df.columns)), "\t").alias("line"))
    with open(path, "w", encoding="utf-8") as out:
        out.write(f"-- a dump\nCOPY public.customer ({', '.join(df.columns)}) FROM stdin;\n")
        out.writelines(row["line"] + "\n" for row in lines.toLocalIterator())
        out.write("\\.\n")
    return sqldump.read_table(spark, path, "public.customer")


register("sqldump_copy_source", _dump, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")

_STREAMED = 'salt = "s"\n[rules.events]\nevent_type = { strategy = "hash" }\n[row_filters.events]\ndelete = [{ column = "props.k", op = "lt", value = 20 }]'


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy over a stream of files, to its end."""
    import uuid

    place = f"{storage.folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type", "props")
    done = streams.apply(masking(_STREAMED), source, "events").writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{place}/out")


register("stream_mask_events", _stream, "SELECT event_id, sha256('s' || event_type) AS event_type, props FROM events WHERE NOT CAST(props->>'$.k' AS DOUBLE) < 20")
