"""Quality rules (operator 8): measures of a text, and cutoffs whose false rejections are bounded on labelled holdouts.

A rule rejects a document if a ratio of its measures is over a cutoff. The rules' cutoffs form one path: those of the first
rule, the loosest first, then those of the second, and so on. At a point of the path all cutoffs up to there hold together,
so a document is rejected there if the first cutoff on the path that it is over comes no later. Which rule comes first is
decided by documents labelled bad alone: by how many of those that the base rules pass a rule rejects, on average over its
cutoffs. So the path doesn't depend on the good documents that its points are tested on.

Points are chosen per stratum (by default the language) on documents labelled good, none of which any measure was fitted
to. Of those in a stratum that the base rules pass, ``n`` in number, ``k`` are rejected at a point. The point is certified
if ``k`` or fewer of ``n`` would have a probability of at most ``alpha / strata`` were the true rate of false rejection, by
all rules together, as high as ``limit``: an exact binomial tail. ``strata`` is the number of strata that have enough good
documents for any point to be certified (Bonferroni; it depends on nothing but their numbers). Within a stratum points are
tested from the start of the path on and testing ends at the first that fails, so they need no further correction. With
the given confidence no stratum loses more than ``limit`` of its good documents to the cutoffs; what the base rules
reject, which are fixed, comes on top. Where no point is certified the cutoffs reject nothing.

Built-in functions only. The measures take one pass without a shuffle; what is joined and grouped afterwards is narrow.

Null text has no words, so its base rule fails. Null strata form one of their own. Labels that are null are not used; a
document with several labels counts as good if all are, else as bad. Rules that reject equally many bad documents come by
name. An empty table gives no rows, no labels no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
ALPHA, LIMIT = 0.05, 0.02

#: Rule: its ratio as SQL, and its cutoffs, the loosest first.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08)),
    "word_length": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0)),
    "shouting": ("n_upper / greatest(word_chars, 1)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.29, 0.27, 0.25, 0.2, 0.15, 0.1)),
}


def measures(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of each row's whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda chars: F.length(F.translate(text, chars, ""))
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    a = docs.select(*kept, words.alias("words"), lines.alias("lines"), gone(SPACES).alias("word_chars"), (F.length(text) - gone(SYMBOLS)).alias("n_symbols"), (F.length(text) - gone(UPPER)).alias("n_upper"))
    names = [f"k{i}" for i in range(len(keep))] + ["word_chars", "n_symbols", "n_upper"]
    b = a.select(*names, F.size("words").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("word_hash"))
    names += ["n_words", "n_lines", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), lambda i: F.xxhash64(*(F.get("word_hash", i + j) for j in range(WINDOW))))
    c = b.select(*names, F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = c.select(*names, F.when(F.size("windows") != F.size(F.array_distinct("windows")), ordered).alias("sorted"))
    same = F.filter("sorted", lambda e, i: (F.get("sorted", i - 1)["h"].eqNullSafe(e["h"])) | (F.get("sorted", i + 1)["h"].eqNullSafe(e["h"])))
    e = d.select(*names, F.array_sort(F.transform(same, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    out = e.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    names += ["n_repeat_words"]
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(c).cast("long").alias(c) for c in names[len(keep) :]))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at rate p, term by term in logarithms; 1 where k is over n * p, as no such cutoff is certified."""
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def more(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (state["sum"] + F.exp(term)).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, more, lambda s: s["sum"])
    return F.when(k > n * p, 1.0).when(k == 0, F.exp(first)).otherwise(total)


def ranked(measured: DataFrame, bad: DataFrame, *, id_col: str, rules=RULES) -> dict:
    """The rules in the order of their use: how many bad documents, which the base rules pass, are over a cutoff, on average."""
    over = [F.count_if(F.expr(ratio) > c).alias(f"{r}_{c}") for r, (ratio, cs) in rules.items() for c in cs]
    hits = measured.where(~F.col("base_failed")).join(bad, id_col, "left_semi").agg(*over).first()
    mean = {r: sum(hits[f"{r}_{c}"] for c in cs) / len(cs) for r, (_, cs) in rules.items()}
    return {r: rules[r] for r in sorted(rules, key=lambda r: (-mean[r], r))}


def path(rules: dict) -> list[tuple[str, float]]:
    """(rule, cutoff) in the order in which they come to hold, for rules in the order of their use."""
    return [(r, c) for r, (_, cs) in rules.items() for c in cs]


def cutoffs(rated: DataFrame, good: DataFrame, *, id_col: str, points: int, alpha: float = ALPHA, limit: float = LIMIT) -> DataFrame:
    """(own, certified): the last certified point of each stratum that has one.

    ``rated`` has ``id_col``, ``stratum``, ``base_failed`` and ``first``, the place on the path of the first cutoff that a
    document is over, from 1, or null; ``good``: ids of documents labelled good.
    """
    held = rated.where(~F.col("base_failed")).join(good, id_col, "left_semi")
    over = [F.count_if(F.col("first") <= i).alias(f"k{i}") for i in range(1, points + 1)]
    counts = common.cut(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over).where(F.exp(F.col("n") * F.log1p(F.lit(-limit))) <= alpha))
    strata = max(1, counts.count())
    tried = counts.select("stratum", "n", F.posexplode(F.array(*(F.col(f"k{i}") for i in range(1, points + 1)))).alias("before", "k"))
    passed = binomial_tail(F.col("k"), F.col("n"), limit) <= F.lit(alpha / strata)
    best = tried.groupBy("stratum").agg(F.coalesce(F.min(F.when(~passed, F.col("before"))), F.lit(points)).alias("certified"))
    return best.where("certified > 0").withColumnRenamed("stratum", "own")


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", row_col: str | None = None, rules=RULES, alpha: float = ALPHA, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, ``row_col`` if given, measures, ``base_failed``, ``kept``, ``failed_rules`` (array)."""
    keep = [id_col, stratum_col] + ([row_col] if row_col else [])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = measures(docs, *keep, text_col=text_col).withColumn("base_failed", base).withColumnRenamed(stratum_col, "stratum")
    measured = common.cut(measured)
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("least"))
    good, bad = (labelled.where(x).select(id_col) for x in ("least = 1", "least <> 1"))
    points = path(ranked(measured, bad, id_col=id_col, rules=rules))
    over = [F.expr(rules[r][0]) > c for r, c in points]
    first = F.array_min(F.array(*(F.when(x, F.lit(i)) for i, x in enumerate(over, 1))))
    rated = measured.withColumn("first", first)
    limits = common.cut(cutoffs(rated, good, id_col=id_col, points=len(points), alpha=alpha, limit=limit))
    judged = rated.join(limits, F.col("stratum").eqNullSafe(F.col("own")), "left")
    failed = F.array_distinct(F.filter(F.array(*(F.when(x & (F.col("certified") >= i), F.lit(r)) for i, ((r, _), x) in enumerate(zip(points, over, strict=True), 1))), lambda x: x.isNotNull()))
    measured_names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("first") <= F.col("certified"), F.lit(False))
    return judged.select(id_col, *([row_col] if row_col else []), *measured_names, "base_failed", kept.alias("kept"), failed.alias("failed_rules"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir), common.labels(spark, sf_dir)).drop("failed_rules")


#: The cutoffs again as SQL, written out: rule, step, cutoff.
_SQL_CUTOFFS = """
('symbols', 1, 0.6), ('symbols', 2, 0.5), ('symbols', 3, 0.4), ('symbols', 4, 0.35), ('symbols', 5, 0.3), ('symbols', 6, 0.25), ('symbols', 7, 0.2), ('symbols', 8, 0.15), ('symbols', 9, 0.1), ('symbols', 10, 0.08),
('word_length', 1, 40), ('word_length', 2, 30), ('word_length', 3, 25), ('word_length', 4, 20), ('word_length', 5, 17), ('word_length', 6, 15), ('word_length', 7, 13),
('shouting', 1, 0.95), ('shouting', 2, 0.9), ('shouting', 3, 0.8), ('shouting', 4, 0.7), ('shouting', 5, 0.6), ('shouting', 6, 0.5), ('shouting', 7, 0.4), ('shouting', 8, 0.3),
('lines', 1, 0.8), ('lines', 2, 0.7), ('lines', 3, 0.6), ('lines', 4, 0.5), ('lines', 5, 0.4), ('lines', 6, 0.3), ('lines', 7, 0.25), ('lines', 8, 0.2),
('repeats', 1, 0.29), ('repeats', 2, 0.27), ('repeats', 3, 0.25), ('repeats', 4, 0.2), ('repeats', 5, 0.15), ('repeats', 6, 0.1)"""
ORACLE = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM dup, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
cutoffs(rule, step, cutoff) AS (VALUES {_SQL_CUTOFFS}),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
ratios AS (UNPIVOT (SELECT doc_id, n_symbols / greatest(word_chars, 1) AS symbols, n_dup_lines / greatest(n_lines, 1) AS lines, n_repeat_words / greatest(n_words, 1) AS repeats, n_upper / greatest(word_chars, 1) AS shouting, word_chars / greatest(n_words, 1) AS word_length FROM r) ON symbols, lines, repeats, shouting, word_length INTO NAME rule VALUE ratio),
labelled AS (SELECT doc_id, min(quality) AS least FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
bad AS (SELECT doc_id FROM r SEMI JOIN (SELECT doc_id FROM labelled WHERE least <> 1) USING (doc_id) WHERE NOT base_failed),
means AS (SELECT c.rule, count(x.doc_id) / count(DISTINCT c.step) AS mean FROM cutoffs c LEFT JOIN (SELECT * FROM ratios SEMI JOIN bad USING (doc_id)) x ON x.rule = c.rule AND x.ratio > CAST(c.cutoff AS DOUBLE) GROUP BY c.rule),
path AS (SELECT rule, cutoff, row_number() OVER (ORDER BY mean DESC, rule, step) AS place FROM cutoffs JOIN means USING (rule)),
f AS (SELECT doc_id, min(place) AS first FROM ratios JOIN path USING (rule) WHERE ratio > CAST(cutoff AS DOUBLE) GROUP BY doc_id),
good AS (SELECT doc_id FROM labelled WHERE least = 1),
held AS (SELECT r.doc_id, lang, first FROM r SEMI JOIN good USING (doc_id) LEFT JOIN f USING (doc_id) WHERE NOT base_failed),
sizes AS (SELECT lang, count(*) AS n FROM held GROUP BY lang HAVING 0.98 ** count(*) <= 0.05),
tried AS (SELECT s.lang, n, place, (SELECT count(*) FROM held h WHERE h.lang IS NOT DISTINCT FROM s.lang AND first <= place) AS k FROM sizes s CROSS JOIN path),
tested AS (SELECT *, k <= n * 0.02 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) <= 0.05 / (SELECT count(*) FROM sizes) AS passed FROM tried),
best AS (SELECT lang, coalesce(min(place) FILTER (WHERE NOT passed) - 1, 39) AS certified FROM tested GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(first <= certified, false) AS kept
FROM r LEFT JOIN f USING (doc_id) LEFT JOIN best ON r.lang IS NOT DISTINCT FROM best.lang
"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {"op8_quality_rules": ORACLE}
