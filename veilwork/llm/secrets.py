"""Secret scans (operator 3): patterns, and weak parts of credentials that are reported only when they complement each other.

Base kinds are strong enough alone: ``assign`` (a named value of six characters or more), ``access`` (an access key
identifier) and ``hex`` (24 or more hexadecimal digits). Weak parts are ``ident`` (user, account and client names),
``key`` (values named like a credential, or whole runs of 40 or more letters, digits and ``+/_-``) and ``endpoint``
(addresses of services). A weak part is reported only if a part that complements it lies within ``scope`` code points: a key needs an
identifier or an endpoint, an identifier or an endpoint needs a key. Base spans count as parts (access as an identifier,
assign and hex as keys) of the weak parts beside them, not of those they overlap. A weak part that one base span covers is
not reported again, but complements others as any part does; one that a base span covers in part is reported whole. An
unnamed run and a part that overlaps it, such as the address it is a path of, don't complement each other; a named value in
an address does.

Parts are linked by an interval join: both sides are dealt to bins of positions of their document, joined on row and bin
and compared by distance. A bin has room for few parts, so no document, however long, makes a large group. Only rows that
have weak parts of complementary kinds are exploded. Built-in functions only.

Null text counts as empty. A row without secrets has empty lists. Rows with equal or null ids are scanned each for itself.
An empty table gives no rows. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.functions import arrays

from . import common

SCOPE = 200
VALUE = r"[A-Za-z0-9+/_.=-]"
RUN = r"[A-Za-z0-9+/_-]"
KEYS = "(?i:private_?key|auth_?key|access_?key|pass|pwd|credential|signature)"
QUOTED = r"""["']?\x20*[:=]\x20*["']?"""
#: Kind: pattern, group and its least length, in the order of report at equal starts.
BASE = {
    "assign": (rf"(?i:password|passwd|secret|token|api_?key){QUOTED}({VALUE}+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "ident": (rf"(?i:user_?name|user_?id|user|login|account_?id|account|client_?id|key_?id){QUOTED}([A-Za-z0-9_.@-]+)", 1, 3),
    "key": (rf"{KEYS}{QUOTED}({VALUE}+)|(?={RUN}{{40}})(?:{RUN}*{KEYS}{QUOTED}{VALUE}+|{RUN}+)", 0, 6),  # a run may end in the name of a value
    "endpoint": (r"(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+)://[^\x20\x09-\x0D\"'<>|]+", 0, 10),
}
KINDS = [*BASE, *WEAK]
#: The rank of unnamed keys until parts are linked.
LOOSE = len(KINDS)
#: The side on which a kind stands, and the sides that complement a weak kind.
SIDE = {"assign": "key", "hex": "key", "access": "ident", "ident": "ident", "key": "key", "endpoint": "endpoint"}
NEEDS = {"ident": ["key"], "endpoint": ["key"], "key": ["ident", "endpoint"]}
SPAN = "array<struct<start:int,rank:int,end:int>>"
STRETCH = 1024


def spans_of(text: Column, kind: str) -> Column:
    """Spans of a kind's matches, leftmost and not overlapping; matches whose group is too short are dropped.

    What a pattern matches and what stands between are alternating pieces of the text, so their running lengths are places.
    """
    pattern, group, least = (BASE | WEAK)[kind]
    rank = KINDS.index(kind)
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    valued = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else F.transform(matched, lambda m: F.length(m))
    between = F.transform(F.split(text, pattern), lambda x: F.length(x))
    ranked = lambda m: F.struct(F.length(m).alias("len"), (F.when(m.rlike("[:=]"), rank).otherwise(LOOSE) if kind == "key" else F.lit(rank)).alias("rank"))
    pieces = F.arrays_zip(between.alias("gap"), F.transform(matched, ranked).alias("m"), valued.alias("value"))

    def placed(all_: Column) -> Column:
        before = arrays.prefix_sums(all_, lambda x: x["gap"] + F.coalesce(x["m"]["len"], F.lit(0)))
        both = F.filter(F.arrays_zip(all_.alias("x"), before.alias("at")), lambda z: z["x"]["value"] >= least)
        start = lambda z: z["at"] + z["x"]["gap"]
        return F.transform(both, lambda z: F.struct(start(z).alias("start"), z["x"]["m"]["rank"].alias("rank"), (start(z) + z["x"]["m"]["len"]).alias("end")))

    return F.when(text.rlike(pattern), arrays.let(pieces, placed)).otherwise(F.array().cast(SPAN))


def _bare(base: Column, weak: Column) -> Column:
    """The weak spans that no single base span covers: of the base spans that begin no later none ends as late or later."""
    event = lambda s, kind: F.struct(s["start"].alias("start"), F.lit(kind).alias("weak"), s["rank"].alias("rank"), s["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(base, lambda s: event(s, 0)), F.transform(weak, lambda s: event(s, 1))))

    def kept(all_: Column) -> Column:
        reach = arrays.prefix_greatest(all_, lambda e: F.when(e["weak"] == 0, e["end"]).otherwise(-1))
        both = F.filter(F.arrays_zip(all_.alias("e"), reach.alias("reach")), lambda z: (z["e"]["weak"] == 1) & (z["reach"] < z["e"]["end"]))
        return F.transform(both, lambda z: F.struct(z["e"]["start"].alias("start"), z["e"]["rank"].alias("rank"), z["e"]["end"].alias("end")))

    return arrays.let(events, kept)


def _bins(low: Column, high: Column, scope: int) -> Column:
    width = 2 * scope
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, added): the weak spans of each row that a complementary part lies within ``scope`` of. Rows without are left out.

    ``scanned`` has ``row``, ``base`` and ``weak`` spans.
    """
    plain = lambda rank: F.when(rank == LOOSE, KINDS.index("key")).otherwise(rank)
    side = lambda rank: F.element_at(F.array(*(F.lit(SIDE[k]) for k in KINDS)), plain(rank) + 1)
    sides = F.array_distinct(F.transform(F.concat("base", "weak"), lambda s: side(s["rank"])))
    likely = scanned.where((F.size("weak") > 0) & (F.size(sides) > 1) & F.array_contains(sides, "key"))
    weak = likely.select("row", F.explode(_bare(F.col("base"), F.col("weak"))).alias("w")).select("row", "w", _bins(F.col("w.start"), F.col("w.end"), scope).alias("bin"))
    parts = likely.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p", _bins(F.col("p.start") - scope, F.col("p.end") + scope, scope).alias("bin"))
    needs = F.element_at(F.array(*(F.array(*(F.lit(s) for s in NEEDS.get(k, []))).cast("array<string>") for k in KINDS)), plain(F.col("w.rank")) + 1)
    near = (F.col("p.start") <= F.col("w.end") + scope) & (F.col("p.end") >= F.col("w.start") - scope)
    complete = F.array_contains(needs, side(F.col("p.rank")))
    named = F.col("p.rank").between(len(BASE), LOOSE - 1) & (F.col("w.rank") != LOOSE)
    beside = named | (F.col("p.start") >= F.col("w.end")) | (F.col("p.end") <= F.col("w.start"))
    a, b = weak.alias("a"), parts.alias("b")
    joined = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.bin") == F.col("b.bin")) & near & complete & beside, "left_semi")
    reported = F.struct(F.col("w.start").alias("start"), plain(F.col("w.rank")).alias("rank"), F.col("w.end").alias("end"))
    return joined.select("row", reported.alias("w")).distinct().groupBy("row").agg(F.collect_list("w").alias("added"))


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: id, ``row`` (``row_col``, or a running number), ``base`` and ``found`` (base and
    added spans), both ordered: arrays of (start, rank of the kind in ``KINDS``, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = F.array_sort(F.concat(*(spans_of(F.col("t"), k) for k in BASE)))
    weak = F.concat(*(spans_of(F.col("t"), k) for k in WEAK))
    read = docs.select(F.col(id_col).alias("id"), row.alias("row"), text.alias("t"))
    scanned = common.cut(read.select("id", "row", base.alias("base"), weak.alias("weak")))
    added = link(scanned, scope)
    found = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    out = scanned.join(added, "row", "left").select(F.col("id").alias(id_col), "row", "base", found.alias("found"))
    return out


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span, or run of overlapping spans, replaced. ``spans`` must be ordered by start.

    A text is cut into stretches of ``STRETCH`` code points and runs are cut where stretches begin. In order of place, what
    stands between one cut and the next lies in one stretch, so no step looks at more of the text than that.
    """
    none = F.array().cast("array<struct<start:int,end:int,mark:string>>")
    event = lambda start, end, shown: F.struct(start.alias("start"), end.alias("end"), shown.alias("mark"))

    def runs(all_: Column) -> Column:
        """(start, end) of runs: a span begins one if all before it end no later than it starts."""
        reach = F.arrays_zip(all_.alias("s"), arrays.prefix_greatest(all_, lambda s: s["end"]).alias("reach"))
        fresh = lambda z: F.filter(z, lambda x: x["reach"] <= x["s"]["start"])
        last = F.array_max(F.transform(all_, lambda s: s["end"]))
        return arrays.let(fresh(reach), lambda f: F.transform(f, lambda x, i: F.struct(x["s"]["start"].alias("start"), F.coalesce(F.get(f, i + 1)["reach"], last).alias("end"))))

    def pieces(run: Column) -> Column:
        of = lambda k: event(F.greatest(run["start"], k * STRETCH), F.least(run["end"], (k + 1) * STRETCH), F.when(k * STRETCH <= run["start"], mark).otherwise(""))
        first, last = (F.floor(x / STRETCH).cast("int") for x in (run["start"], run["end"] - 1))
        return F.transform(F.sequence(first, last), of)

    def rebuilt(x: Column) -> Column:
        between = lambda e, i: F.coalesce(F.get(x["events"], i + 1)["start"], F.length(text)) - e["end"]
        within = lambda e, i: F.substring(F.coalesce(F.get(x["stretches"], F.floor(e["end"] / STRETCH).cast("int")), F.lit("")), F.pmod(e["end"], F.lit(STRETCH)) + 1, between(e, i))
        return F.array_join(F.transform(x["events"], lambda e, i: F.concat(e["mark"], within(e, i))), "")

    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    begins = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / STRETCH).cast("int")), lambda k: event(k * STRETCH, k * STRETCH, F.lit("")))
    hidden = F.flatten(F.transform(arrays.let(F.filter(spans, lambda s: s["end"] > s["start"]), runs), pieces))
    events = F.array_sort(F.concat(begins, F.coalesce(hidden, none)))
    whole = arrays.let(F.struct(events.alias("events"), stretches.alias("stretches")), rebuilt)
    return F.when((F.size(spans) > 0) & (F.length(text) > 0), whole).otherwise(text)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = secret_scan(common.documents(spark, sf_dir))
    of_rank = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    counts = [of_rank(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return scan.select("doc_id", *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


#: The patterns again as SQL, written out: kind, the side it stands on, pattern, group and its least length. DuckDB's patterns
#: can't look ahead, so a run of 40 or more that ends in the name of a value is spelled by the length of that name.
_SQL_KINDS = (
    ("assign", "key", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "ident", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", "key", r"[0-9a-f]+", 0, 24),
    ("ident", "ident", r"""(?i:user_?name|user_?id|user|login|account_?id|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    ("key", "key", r"""(?i:private_?key|auth_?key|access_?key|pass|pwd|credential|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+|(?:[A-Za-z0-9+/_-]{29,}(?i:private_key)|[A-Za-z0-9+/_-]{30,}(?i:privatekey|access_key|credential)|[A-Za-z0-9+/_-]{31,}(?i:accesskey|signature)|[A-Za-z0-9+/_-]{32,}(?i:auth_key)|[A-Za-z0-9+/_-]{33,}(?i:authkey)|[A-Za-z0-9+/_-]{36,}(?i:pass)|[A-Za-z0-9+/_-]{37,}(?i:pwd))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+|[A-Za-z0-9+/_-]{40,}""", 0, 6),
    ("endpoint", "endpoint", r"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>|]+""", 0, 10),
)


def _oracle() -> str:
    """Places from the lengths of what is split and what is matched; every weak span against every part of its text."""

    def spans(rank: int, kind: str, side: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return rf"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, '{side}' AS side, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s, unnest(m) AS x, unnest(v) AS v, {least} AS least
FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS g FROM t)"""

    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, rank, kind, side, s::BIGINT AS s, (s + length(x))::BIGINT AS e, kind = 'key' AND NOT regexp_matches(x, '[:=]') AS loose FROM ({" UNION ALL ".join(spans(i, *k) for i, k in enumerate(_SQL_KINDS))}) WHERE length(v) >= least),
base AS (SELECT * FROM a WHERE rank < 3),
weak AS (SELECT * FROM a w WHERE rank >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s <= w.s AND w.e <= b.e)),
added AS (SELECT DISTINCT w.* FROM weak w JOIN a p ON w.doc_id = p.doc_id AND p.s <= w.e + 200 AND p.e >= w.s - 200 AND (w.side = 'key') <> (p.side = 'key') AND ((p.rank >= 3 AND NOT p.loose AND NOT w.loose) OR p.s >= w.e OR p.e <= w.s)),
b AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e), '') AS base FROM base GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e), '') AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE_SQL = {"op3_secret_scan": _oracle()}
