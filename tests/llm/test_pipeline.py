"""The pipeline against a plain version of its stages."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from helpers import prose
from test_operators import brute_base, brute_measures, brute_near, long_copies

from veilwork.llm import secrets, token_counts, wordbpe

SPACE = r"[\x20\x09-\x0D]"
SECRET = " token = 'abcdef0123456789abcdef0123' end"
#: Weak parts that complement each other.
LINKED = " user: alice pwd = hunter2x end"


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    more = [(500, dict(rows)[303] + SECRET), (500, dict(rows)[303] + SECRET), (None, " ".join(f"w{i}" for i in range(40)) + SECRET)]
    more += [(501, " ".join(f"v{i}" for i in range(40)) + LINKED)]
    docs = [(i, t, None if n % 4 == 0 else "en", "s", 0, "extra") for n, (i, t) in enumerate(rows + more)]
    docs += [(2000 + i, prose(2000 + i, 25), "zz", "s", 0, "extra") for i in range(170)] + [(3000 + i, prose(3000 + i, 25) + " ###" * 9, lang, "s", 0, "extra") for i, lang in enumerate(["zz", "zz", "en", None])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, words string").repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, 1 if lang == "zz" else n % 2, 0) for n, (i, _, lang, *_) in enumerate(docs) if (i or 0) < 3000], "doc_id bigint, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place), [(d[0], d[1]) for d in docs]


def order(row):
    return row[0] is None, row[0] or 0


def test_stages_equal_a_plain_version(spark, folder, tmp_path):
    place, docs = folder
    kept = [docs]
    now = []
    for i, t in docs:
        m = brute_measures(t)
        junk = i in (3000, 3001)  # over a cutoff that enough good documents of their language certify
        if m[0] >= 20 and 100 * m[4] <= 30 * m[0] and not junk:
            now.append((i, t))
    kept.append(now)
    groups = defaultdict(list)
    for i, t in now:
        groups[re.sub(SPACE, "", t)].append((-len(t), i is None, i or 0, t))
    now = [(None if g[1] else g[2], g[3]) for g in map(min, groups.values())]
    kept.append(now)
    component = Counter(c for _, _, c in brute_near(now, 5, 80))
    first = {i for i, _, c in brute_near(now, 5, 80) if i is None or i == c}
    now = [(i, t) for i, t in now if i in first]
    assert max(component.values()) > 1
    kept.append(now)
    kept.append([(i, redacted(t)) for i, t in now])

    df = spark.read.parquet(f"{place}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, place).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == df.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(kept[k + 1]), corpus_pipeline.STAGES[k][0]
        df = out
    bpe = wordbpe.load(token_counts.vocabulary())
    assert Counter({r.doc_id: n for r, n in Counter(df.where("start = 0").collect()).items()}) == Counter(i for i, _ in kept[-1])
    assert df.groupBy().sum("length").first()[0] == sum(len(bpe.encode(t)) // 4 + 1 for _, t in kept[-1])
    whole = corpus_pipeline.run(spark, place).collect()
    assert sum(r.length for r in whole) == df.groupBy().sum("length").first()[0]


def test_rows_keep_their_numbers_when_cores_change(spark, folder, monkeypatch):
    """The split of files follows the number of cores, which may change between an operator and the join with its result."""
    place, _ = folder
    key = "spark.sql.leafNodeDefaultParallelism"
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    df = spark.read.parquet(f"{place}/documents.parquet")
    stages = corpus_pipeline.STAGES[:4]
    want = [sorted(map(str, stage(spark, df, place).collect())) for _, stage in stages]

    def changing(operator):
        def run(*given, **more):
            out = operator(*given, **more)
            spark.conf.set(key, 1)
            spark.conf.set(sizes[0], "1k")
            spark.conf.set(sizes[1], "0")
            return out

        return run

    for name in ("quality", "exact_dedup", "ngram_join", "secret_scan"):
        monkeypatch.setattr(corpus_pipeline, name, changing(getattr(corpus_pipeline, name)))
    for (name, stage), rows in zip(stages, want, strict=True):
        spark.conf.set(key, 7)
        try:
            got = sorted(map(str, stage(spark, df, place).collect()))
        finally:
            for k in (key, *sizes):
                spark.conf.unset(k)
        assert got == rows, name


def redacted(text):
    """Base spans, with overlapping ones as one; but for LINKED these texts have no weak parts that complement each other."""
    if text.endswith(LINKED):
        return text.replace("user: alice pwd = hunter2x", "[REDACTED] [REDACTED]")
    spans = [(s, e) for s, _, e in brute_base(text)]
    assert not any(re.search(p, text) for p, _, _ in secrets.WEAK.values()) or "token" in text
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], "[REDACTED]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_empty_tables(spark, folder, tmp_path):
    place, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{place}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_near_copies(spark, tmp_path):
    """At 80 % of shingles of five words the copies with 2,200 and 3,000 new words go, the one with 4,000 stays."""
    rows = long_copies()
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert {i for i, _, c in brute_near(rows, 5, 80) if i == c} == {1, 4, 5}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bpe = wordbpe.load(token_counts.vocabulary())
    assert {r.doc_id: r.doc_tokens for r in whole} == {i: len(bpe.encode(t)) // 4 + 1 for i, t in rows if i in (1, 4, 5)}
    assert sum(r.length for r in whole) == sum({r.doc_id: r.doc_tokens for r in whole}.values())
