import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import edited, prose
from veilwork.llm import exact_dedup, language_id, ngram_join, packing, quality, secrets, sentencepieces, sharedkeys, suffix_dedup, token_counts, toxicity, wordbpe

SPACE = r"[\x20\x09-\x0D]"


def key(row):
    return tuple((x is None, str(x)) for x in row)


# -- 1, 4: tokens -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    return wordbpe.load(token_counts.vocabulary())


def test_counts_equal_the_library_at_every_prefix(bpe):
    r = random.Random(5)
    for _ in range(150):
        text = "".join(r.choice("abcdeéßÉ '’!#日本<|startoftext|>😀\n s12½") for _ in range(r.randint(0, 25))) + r.choice(["", "<|endoftext|>x"])
        found = bpe.count(text)
        want = [len(bpe.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert found.total == want[-1] and bpe.encode(text) == np.array(bpe.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not found.normalised:
            assert found.counts().tolist() == want
            for budget in (0, 1, 4):
                assert found.longest_within(budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_token_counts(odd, none, rows, bpe):
    got = token_counts.token_counts(odd, budgets=[5], prefixes=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(((i, len((t or "").encode()), len(bpe.library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=key)
    assert all(len(r.prefix_counts) == r.n_chars + 1 and r.prefix_counts[-1] == r.n_tokens and r.prefix_counts[r.fit_5] <= 5 for r in got)
    assert token_counts.token_counts(none).count() == 0


def test_any_budget_is_answered_from_the_stored_prefixes(spark, odd, none, rows, bpe, tmp_path):
    token_counts.prefix_table(odd).write.parquet(str(tmp_path / "prefixes"))
    stored = spark.read.parquet(str(tmp_path / "prefixes"))
    budgets = [0, 1, 7, 100, 10**6]
    got = token_counts.fit_within(stored, budgets).collect()
    want = token_counts.token_counts(odd, budgets=budgets).collect()
    shown = lambda found: sorted(((r.doc_id, *(r[f"fit_{b}"] for b in budgets)) for r in found), key=key)
    assert shown(got) == shown(want) and len(got) == len(rows)
    jumpy = np.array([0, 300, 2, 5])
    assert token_counts.counts_of(token_counts.steps_of(jumpy), 3).tolist() == jumpy.tolist()
    assert token_counts.fit_within(token_counts.prefix_table(none), [5]).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        token_counts.token_counts(odd.withColumnRenamed("doc_id", "n_tokens"), id_col="n_tokens")


def test_packing(spark, odd, none, rows, bpe):
    got = packing.pack(odd, capacity=256, block=2000).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(bpe.library.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    for r in got:
        assert r.length > 0 and any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0
    whole = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert whole == Counter((i, len(x)) for i, xs in ids.items() for x in xs)
    assert packing.pack(none).count() == 0
    assert sorted(map(tuple, packing.pack(odd, capacity=256, block=2000).collect()), key=key) == sorted(map(tuple, got), key=key)


def test_cost_balance():
    sizes = [1000, 900, 500, 400, 300, 200, 100, 50, 50, 596]
    pieces = packing.assign(sizes, [2048, 2048])
    load = [sum(packing.cost(n) for _, _, n in p) for p in pieces]
    assert [sum(n for _, _, n in p) for p in pieces] == [2048, 2048] and max(load) < 1.15 * min(load)
    assert packing.assign([], []) == [] and packing.powers(13) == [8, 4, 1]


def test_documents_are_cut_only_if_no_sequence_has_room():
    def brute(sizes, rooms):
        left, spent, out = list(rooms), [0.0] * len(rooms), [[] for _ in rooms]
        for item in sorted(range(len(sizes)), key=lambda i: (-packing.cost(sizes[i]), i)):
            at = 0
            while at < sizes[item]:
                rest = sizes[item] - at
                _, i = min((spent[i], i) for i in range(len(rooms)) if left[i] >= rest or (max(left) < rest and left[i]))
                n = min(rest, left[i])
                out[i].append((item, at, n))
                left[i], spent[i], at = left[i] - n, spent[i] + packing.cost(n), at + n
        return out

    assert packing.assign([100] + [60] * 12, [100] + [60] * 12) == brute([100] + [60] * 12, [100] + [60] * 12)
    for seed in range(20):
        r = random.Random(seed)
        sizes = [min(2047, 1 + int(r.lognormvariate(6, 1.2))) for _ in range(400)]
        whole, rest = divmod(sum(sizes), 2048)
        rooms = [2048] * whole + packing.powers(rest)
        assert packing.assign(sizes, rooms) == brute(sizes, rooms), seed
    small = packing.assign([60] * 12 + [100], [60] * 12 + [100])
    assert [p for p in small if p] == small and all(len(p) == 1 for p in small)


# -- 9: exact duplicates ----------------------------------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i is None, i or 0, n))
    out = []
    for text, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for _, unknown, i, _ in members:
            i = None if unknown else i
            out.append((i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=key)


def test_exact_dedup(odd, none, rows):
    assert sorted(map(tuple, exact_dedup.exact_dedup(odd, batches=3).collect()), key=key) == brute_exact(rows)
    assert sorted(map(tuple, exact_dedup.exact_dedup(odd, batch=F.lit(0)).collect()), key=key) == brute_exact(rows)
    numbered = odd.withColumn("r", F.monotonically_increasing_id())
    kept = exact_dedup.exact_dedup(numbered, row_col="r").where("kept")
    assert kept.count() == len({re.sub(SPACE, "", t or "") for _, t in rows}) == kept.select("digest").distinct().count()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_the_least_and_greatest_ids(spark):
    rows = [(-(1 << 63), "a b"), ((1 << 63) - 1, "ab"), (0, "a  b"), (5, "x"), (-(1 << 63), "x")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=key) == brute_exact(rows)


def test_equal_digests_of_different_texts_are_told_apart(odd, rows):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_dedup(odd, digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=key) == sorted((x[:4] for x in brute_exact(rows)), key=key)


def test_binary_fuse_never_denies_a_key():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 100, 100_000):
        keys = r.integers(0, 1 << 63, n, dtype=np.uint64)
        f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(np.concatenate((keys, keys))).to_bytes())
        assert f.holds(keys).all()
        if n == 100_000:
            assert f.holds(r.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.01 and len(f.table) < 1.25 * n


# -- 10: near duplicates ----------------------------------------------------------------------------------------------------


def brute_near(rows, words, percent):
    sets = []
    for i, t in rows:
        w = [x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[top(a)] = top(b)
    ids = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[top(n)].append(i)
    return sorted(((i, len(sets[n]), min((x for x in ids[top(n)] if x is not None), default=None) if sets[n] else i) for n, (i, _) in enumerate(rows)), key=key)


@pytest.mark.parametrize("words, percent", [(5, 80), (4, 85)])
def test_ngram_join(odd, none, rows, words, percent):
    got = ngram_join.ngram_join(odd, words=words, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_near(rows, words, percent)
    assert ngram_join.ngram_join(none).count() == 0


def test_chains_and_crowds_lose_no_link(spark):
    base, rows = prose(9, 120), []
    text = base
    for i in range(30):  # a chain: each is like the next, the ends are not alike
        rows.append((i, text))
        words = text.split()
        words[i * 4 : i * 4 + 2] = [f"new{i}a", f"new{i}b"]
        text = " ".join(words)
    crowd = prose(10, 150)
    rows += [(1000 + i, edited(crowd, i, 45)) for i in range(120)] + [(2000 + i, prose(500 + i, 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = ngram_join.ngram_join(df).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_near(rows, 5, 80)
    assert sorted(map(tuple, got), key=key) == want and len({x[2] for x in want if x[0] < 30}) == 1


def long_copies():
    """A long text, and copies of it in which a stretch of thousands of words is new: of 2,200 words, of 3,000 and of 4,000."""
    base = prose(900, 28_000).split()
    return [(1, " ".join(base)), *((i, " ".join(base[: 9000 * i - 17_000] + prose(900 + i, n).split() + base[9000 * i - 17_000 + n :])) for i, n in ((2, 2200), (3, 3000), (4, 4000))), (5, prose(910, 40))]


def test_thousands_of_own_tokens(spark):
    rows = long_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(df, words=4, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(brute_near(rows, 4, 85))
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


@pytest.mark.parametrize("texts", [[prose(920, 60), edited(prose(920, 60), 921, 30), prose(922, 50), prose(923, 50)], [prose(920, 60), prose(920, 60).replace(" ", "\n")]])
def test_blocks_without_frequent_keys_and_of_frequent_keys_alone(spark, texts):
    rows = list(enumerate(texts))  # half of them in each of two tasks
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = ngram_join.ngram_join(df, words=4, percent=85, least=2, share=0.0).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_near(rows, 4, 85)


@pytest.mark.parametrize("more", [{"least": 2, "share": 0.0}, {"least": 3, "share": 0.0, "sample": 2000}, {"least": 2, "share": 0.0, "most": 50}, {"class_bits": 3}, {"least": 2, "share": 0.05, "class_bits": 5}])
def test_frequent_keys_and_clashing_numbers_change_nothing(odd, rows, more):
    got = ngram_join.ngram_join(odd, **more).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_near(rows, 5, 80)


def test_frequent_keys_are_those_of_many_texts(spark):
    texts = [f"a{i} b{i} all these words stand everywhere c{i} d{i}" for i in range(300)] + ["copied words are one text only"] * 400
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    of = lambda t: sharedkeys.key_of(ngram_join.shingles(t, 3))
    keys, times = sharedkeys.frequent(df, of, 3000, share=0.5)
    assert sorted(keys.tolist()) == keys.tolist() == sorted(of("all these words stand everywhere").tolist()) and set(times) == {300}
    few, _ = sharedkeys.frequent(df, of, 3000, least=1, share=0.0, most=7)
    assert len(few) == 7 and set(keys.tolist()) <= set(few.tolist())
    assert len(sharedkeys.frequent(df.limit(0), of, 0)[0]) == 0
    # a key in every class: its bucket's task sees none of it
    table = sharedkeys.Frequent(keys, np.log2(times).astype(np.uint8))
    name = lambda t: (ngram_join.class_of(ngram_join.shingles(t, 3)), 0, of(t))
    sent = sharedkeys.deal(df, name, 64, table, 3).collect()
    straight = [r for r in sent if r["bucket"] < 0]
    assert sum(len(r["keys"]) // 6 for r in straight) >= 900 and {(-1 - r["bucket"]) // 64 for r in straight} <= {0, 1, 2}
    assert not any(np.isin(sharedkeys.unplanes(r["keys"]), keys).any() for r in sent if r["bucket"] >= 0)


def test_buckets_are_ranges_whatever_their_number():
    k = np.sort(np.random.default_rng(3).integers(0, 1 << 48, 10_000).astype(np.uint64))
    for n in (1, 64, 1 << 15, 1 << 20, 1 << 30):
        b = sharedkeys.bucket_of(k, n)
        assert (np.diff(b) >= 0).all() and b.min() >= 0 and b.max() < n


def test_shared_keys_round_trip():
    k = np.sort(np.random.default_rng(2).integers(0, 1 << 48, 1000).astype(np.uint64))
    assert (sharedkeys.unplanes(sharedkeys.planes(k)) == k).all()


# -- 5: shared substrings ---------------------------------------------------------------------------------------------------


def brute_substrings(rows):
    big, first = 1 << 63, {}
    raw = [((big if i is None else i), (t or "").encode()) for i, t in rows]
    for order, b in sorted(raw):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], order)
    out = []
    for (i, _), (order, b) in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order:
                gone[k : k + 50] = 1
        kept = np.frombuffer(b, np.uint8)[gone[:-1] == 0].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("more", [{}, {"shard_bytes": 3000}, {"least": 2, "share": 0.0}, {"least": 2, "share": 0.0, "shard_bytes": 3000, "salts": 7}, {"least": 3, "share": 0.0, "sample": 9000, "class_bits": 3}, {"class_bits": 2}])
def test_suffix_dedup(odd, rows, more):
    got = suffix_dedup.suffix_dedup(odd, **more).collect()
    shown = [(r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.sha256 if r.kept_bytes is None else hashlib.sha256(r.kept_bytes).hexdigest()) for r in got]
    assert sorted(shown, key=key) == brute_substrings(rows) and all(r.kept_sha256 == x[-1] for r, x in zip(got, shown, strict=True))


def test_a_passage_of_most_documents(spark, none):
    """One passage in nine of ten documents, the same text before it in some; pieces of it are frequent, their windows merged."""
    passage = prose(21, 60)
    rows = [(i * 7 % 200, prose(700 + i, 15) + (f" note {i % 3}: {passage} " if i % 10 else " ") + prose(900 + i, 15)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = suffix_dedup.suffix_dedup(df, with_text=False).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256) for r in got), key=key) == brute_substrings(rows)
    hashes, _ = sharedkeys.frequent(df, lambda t: np.unique(suffix_dedup.pieces(np.frombuffer(t.encode(), np.uint8))), 100_000)
    often = suffix_dedup.Often(hashes)
    place, h, last = suffix_dedup.anchors(np.frombuffer(rows[1][1].encode(), np.uint8), often=often)
    assert np.isin(h[last], hashes).all() and 300 < last[place].sum() < len(place)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_arrays_and_common_prefixes():
    r = np.random.default_rng(3)
    for n in (1, 5, 200, 2000):
        s = r.integers(1, 4, n).astype(np.uint8)
        sa, rank = suffix_dedup.suffix_array(s)
        b = s.tobytes()
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:]) and (rank[sa] == np.arange(n)).all()
        half = n // 2
        lcp = suffix_dedup.common_prefixes(s, sa, rank, np.array([0, half]), np.array([half, n - half]), 10)
        shared = lambda x, y: next((k for k in range(10) if x[k : k + 1] != y[k : k + 1] or not x[k : k + 1]), 10)
        assert lcp[1:].tolist() == [shared(b[sa[k - 1] :], b[sa[k] :]) for k in range(1, n)]


def test_parts_are_merged():
    r = random.Random(4)
    pool = [bytes(r.choices(b"abc", k=60)) for _ in range(6)]
    stretches = [r.choice(pool)[r.randrange(5) :] + bytes(r.choices(b"ab", k=r.randrange(9))) for _ in range(60)]
    ids = np.array([r.randrange(1000) for _ in stretches])
    want = {}
    for x, i in zip(stretches, ids, strict=True):
        for k in range(len(x) - 49):
            want[x[k : k + 50]] = min(want.get(x[k : k + 50], 1 << 60), i)
    for part in (1 << 20, 500, 100):
        got = suffix_dedup.least_ids(stretches, ids, part_bytes=part)
        assert [g.tolist() for g in got] == [[want[x[k : k + 50]] for k in range(len(x) - 49)] for x in stretches]


# -- 3: secrets -------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_scan(spark, none):
    hexes, access = "0123456789abcdef" * 2, "AKIA" + "Z7" * 9
    cases = [
        (1, f"é😀 token = \"{hexes}\" and Password:abc, API_KEY='abcdef' secret=token: abcdefgh"), (2, f"{access} x {access[:19]} AKIA{access}"), (None, None), (3, ""), (3, ""),
        (4, "user_name: alice\npwd = hunter2x\nhttps://db.example.com/x"), (5, "user_name: alice and nothing else https://x.example.com"), (6, "pwd = hunter2x" + " " * 500 + "user: bobby"),
        (7, f"login=root {access}" + "\n" * 150 + "private_key: abc/def+ghi"), (8, "ıpassword=abcdef PASSWD : \"zzzzzz\"" + "a" * 24), (9, "token=abcdef " * 400), (10, "x" * 100_000 + " secret=zzzzzz"),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in cases], "doc_id bigint, text string, row string, base string").repartition(3)
    got = secrets.secret_scan(df, row_col="doc_id").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(cases)
    for i, t in cases:
        assert [tuple(s) for s in by_id[i].base] == brute_base(t or ""), i
    kinds = {r.doc_id: [secrets.KINDS[s["rank"]] for s in r.found] for r in secrets.secret_scan(df).collect()}
    assert kinds[4] == ["ident", "key", "endpoint"] and kinds[5] == [] and kinds[6] == [] and kinds[7] == ["ident", "access", "key"]
    assert secrets.secret_scan(none).count() == 0


def redactions(spark, texts):
    """By text: the kinds found, and the text redacted."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.secret_scan(df).join(df, "doc_id").select("text", "found", secrets.redact(F.col("text"), F.col("found"), "#").alias("out")).collect()
    return {r.text: ([secrets.KINDS[s["rank"]] for s in r.found], r.out) for r in found}


def test_weak_spans_that_overlap_base_spans_complement_others(spark):
    hexes = "0123456789abcdef01234567"
    want = {
        f"client_id: {hexes}\npwd = hunter2x": (["ident", "hex", "key"], "#\n#"), f"client_id: {hexes}": (["hex"], "client_id: #"),
        "https://hooks.example.com/in?token=abcdef123\npwd = hunter2x": (["endpoint", "assign", "key"], "#\n#"), "https://hooks.example.com/in?token=abcdef123": (["assign"], "https://hooks.example.com/in?#"),
        f"user: alice pwd = xyz{hexes}-rest": (["ident", "key", "hex"], "# #"), f"pwd = xyz{hexes}-rest": (["hex"], "pwd = xyz#-rest"),
        "token=user=alice, pwd = hunter2x": (["assign", "key"], "#, #"), f"client_id: {hexes}" + " " * 500 + "pwd = hunter2x": (["hex"], "client_id: #" + " " * 500 + "pwd = hunter2x"),
    }
    assert redactions(spark, want) == want


def test_unnamed_keys_are_whole_runs(spark):
    run = ("Zq7+x/Wv_t-M" * 8)[:88]
    url = "https://example.com/articles/2024/how-to-bake-the-best-bread-at-home"
    want = {f"user: alice {run[:n]} end": (["ident", "key"], "# # end") for n in (40, 41, 64, 88)} | {
        f"user: alice {run[:39]} end": ([], f"user: alice {run[:39]} end"), f"alice {run} end": ([], f"alice {run} end"), f"see {url} there": ([], f"see {url} there"), f"user: {run}": ([], f"user: {run}"),
        f"{url} {run}": (["endpoint", "key"], "# #"), f"user: alice {run[:50]}pwd = hunter2x!": (["ident", "key"], "# #!"), f"user: alice {run[:38]}pwd = hunter2x!": (["ident", "key"], "# #!"),
        "see https://example.com/in?pwd=hunter2x there": (["endpoint", "key"], "see # there"), "a" * 5000 + "G user: alice": (["hex", "key", "ident"], "# #"),
    }
    assert redactions(spark, want) == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdef! x", [(2, 0, 14), (8, 2, 12)]), (2, "clean", [])], f"i int, t string, s {secrets.SPAN}")
    assert [r[0] for r in df.orderBy("i").select(secrets.redact(F.col("t"), F.col("s"), "#")).collect()] == ["é #! x", "clean"]


def test_redaction_over_stretches(spark):
    """Long texts, spans that overlap, touch, lie at the bounds of stretches or span several of them."""

    def brute(text, found):
        out, at = [], 0
        for a, _, b in found:
            if a >= at:
                out += [text[at:a], "#"]
            at = max(at, b)
        return "".join(out) + text[at:]

    r, cases = random.Random(11), []
    for n in range(30):
        text = "".join(r.choice("abé😀\n") for _ in range(r.choice([1, 1023, 1024, 1025, 5000])))
        cuts = [min(len(text), max(0, r.choice([0, 1024, 2048, len(text)]) + r.randrange(-3, 4))) if r.random() < 0.5 else r.randrange(len(text) + 1) for _ in range(40)]
        cases.append((n, text, sorted((min(a, b), 0, max(a, b)) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a != b)))
    df = spark.createDataFrame(cases, f"i int, t string, s {secrets.SPAN}")
    got = dict(df.select("i", secrets.redact(F.col("t"), F.col("s"), "#").alias("out")).collect())
    assert got == {i: brute(t, s) for i, t, s in cases}


def test_a_text_of_a_hundred_thousand_matches(spark):
    text = "token=abcdefgh user: alice pwd = hunter2x x 0123456789abcdef01234567 " * 25_000
    begun = time.monotonic()
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = secrets.secret_scan(df).join(df, "doc_id").select(F.size("base").alias("base"), F.size("found").alias("found"), secrets.redact(F.col("text"), F.col("found"), "#").alias("out")).first()
    assert (found.base, found.found, found.out) == (50_000, 100_000, "# # # x # " * 25_000) and time.monotonic() - begun < 60


# -- 8: quality -------------------------------------------------------------------------------------------------------------


def brute_measures(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.sub(SPACE, "", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, none, rows, labels, no_labels):
    more = [(400, "a b c d e f g h " * 5), (401, "x\ny\nx\n\n \nx"), (402, "#é* | <b>"), (403, "a b c d e f g h i a b c d e f g h"), (404, ("w " * 7 + "v ") * 3000)]
    df = odd.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in more], "doc_id bigint, text string, lang string"))
    got = quality.quality(df, no_labels).collect()
    want = []
    for i, t in rows + more:
        m = brute_measures(t)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want.append((i, *m, failed, not failed))
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(want, key=key)
    assert quality.quality(odd, labels).count() == len(rows) and quality.quality(none, labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 500), (5, 10000), (40, 10000), (1, 200), (30, 10000)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    got = [r[0] for r in df.select(quality.binomial_tail(F.col("k"), F.col("n"), 0.004)).collect()]
    for (k, n), p in zip(cases, got, strict=True):
        exact = sum(math.comb(n, i) * 0.004**i * 0.996 ** (n - i) for i in range(k + 1)) if k <= 0.004 * n else 1.0
        assert p == pytest.approx(exact, rel=1e-9)


def test_cutoffs_limit_false_rejections(spark):
    """Good documents with one bad in a thousand: the cutoff that would reject more than the share of them is not taken."""
    r = random.Random(6)
    rows = [(i, prose(i % 7, 30) + (" ###" * 60 if i % 3000 == 0 else " #" * r.randrange(3)), "en") for i in range(6000)]
    rows += [(10_000 + i, prose(i, 30) + " ###" * 60, "en") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i in range(6000)] + [(10_000, 0)], "doc_id bigint, quality int")
    got = {x.doc_id: x for x in quality.quality(df, good).collect()}
    assert not any(got[10_000 + i].kept for i in range(5)) and "symbols" in got[10_001].failed_rules
    assert sum(not got[i].kept for i in range(6000)) <= 0.02 * 6000


@pytest.mark.parametrize("junk", [" ###", None])
def test_certified_points_equal_a_plain_search(spark, junk):
    """Three strata, one of them too small, null for a name, and labels of several kinds; points found by plain counting.
    Junk is one word over and over, so that rules which good documents break too come first and nothing is certified, or
    other words each time, so that points are certified which reject some."""
    r, docs = random.Random(12), []
    for i in range(900):
        lang = ("aa", None, "bb")[0 if i < 500 else 1 if i < 800 else 2]
        text = prose(i, 25) + "".join(junk or " ###" + "#" * n for n in range(r.choice([0, 0, 0, 0, 2, 4, 9, 30]) * (i % 7 == 0))) + "\nsame line" * (r.choice([0, 0, 0, 5]) if i % 5 == 0 else 0)
        docs.append((i, text, lang, 0 if "###" * 1 in text and r.random() < 0.99 else r.choice([1, 1, 1, None])))
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id bigint, text string, lang string")
    good = spark.createDataFrame([(d[0], d[3]) for d in docs], "doc_id bigint, quality int")

    def ratios(text):
        words, chars, symbols, dup, rep = brute_measures(text)
        lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
        return {"symbols": symbols / max(chars, 1), "word_length": chars / max(words, 1), "shouting": sum("A" <= c <= "Z" for c in text) / max(chars, 1), "lines": dup / max(len(lines), 1), "repeats": rep / max(words, 1)}

    fails = {i: (m := brute_measures(t))[0] < 20 or 100 * m[4] > 30 * m[0] for i, t, *_ in docs}
    bad = [ratios(t) for i, t, _, label in docs if label == 0 and not fails[i]]
    mean = {rule: sum(x[rule] > c for x in bad for c in cs) / len(cs) for rule, (_, cs) in quality.RULES.items()}
    points = [(rule, c) for rule in sorted(sorted(mean), key=mean.get, reverse=True) for c in quality.RULES[rule][1]]
    assert len(set(mean.values())) > 2
    first = {i: next((n for n, (rule, c) in enumerate(points, 1) if ratios(t)[rule] > c), 99) for i, t, *_ in docs}
    held = defaultdict(list)
    for i, _, lang, label in docs:
        if label == 1 and not fails[i]:
            held[lang].append(first[i])
    held = {k: v for k, v in held.items() if 0.98 ** len(v) <= 0.05}
    certified = {}
    for lang, firsts in held.items():
        tail = lambda k, n: sum(math.comb(n, x) * 0.02**x * 0.98 ** (n - x) for x in range(k + 1))
        passed = [tail(sum(f <= j for f in firsts), len(firsts)) <= 0.05 / len(held) for j in range(1, len(points) + 1)]
        certified[lang] = passed.index(False) if False in passed else len(points)
    want = {i: not fails[i] and not first[i] <= certified.get(lang, 0) for i, _, lang, _ in docs}
    got = {x.doc_id: x.kept for x in quality.quality(df, good).collect()}
    assert got == want and len(held) == 2 and any(not fails[i] and not k for i, k in want.items()) == (junk is None)


def test_good_labels_leave_the_path_alone(spark):
    """The rules' order follows the bad documents: other good ones, or none, give the same path; without bad ones it is by name."""
    docs = [(i, prose(i, 30) + ("\nx" * 6 if i < 5 else "".join(" ###" + "#" * n for n in range(30)) if i < 8 else ""), "en") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    measured = quality.measures(df, "doc_id").withColumn("base_failed", F.col("doc_id") == 5)
    order = lambda *bad: list(quality.ranked(measured, spark.createDataFrame([(i,) for i in bad], "doc_id bigint"), id_col="doc_id"))
    assert order(0, 1, 2, 6)[0] == "lines" and order(0, 5, 6, 7)[0] == "symbols" and order() == sorted(quality.RULES)


# -- 2, 6, 7: models --------------------------------------------------------------------------------------------------------


def test_language_id(spark, odd, none, rows):
    r = random.Random(7)
    words = {"aa": ["kel", "tor", "min", "dra"], "bb": ["xio", "yue", "zha", "qui"], "cc": ["älö", "öyä", "ilä", "yöt"]}
    make = lambda lang, n: " ".join("".join(r.choice(words[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))
    train = [(i, make(lang, 120), lang) for i, lang in enumerate(words) for _ in range(15)] + [(None, None, None), (1, None, "aa"), (2, "x", None)]
    docs = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    model = language_id.learn(docs)
    assert model[0] == ["aa", "bb", "cc"]
    test = [(i, make(lang, 60), lang) for i, lang in enumerate(words) for _ in range(10)] + [(90, make("aa", 90) + " " + make("bb", 60), "aa"), (91, "123 !", "und"), (92, None, "und"), (None, "", "und")]
    got = language_id.identify(spark.createDataFrame(test, "doc_id bigint, text string, lang string"), model).collect()
    right = {(x[0], x[2]) for x in test}
    assert all((g.doc_id, g.lang_pred) in right and 0 <= g.score <= 1 for g in got) and len(got) == len(test)
    mixed = next(g for g in got if g.doc_id == 90).languages
    assert set(mixed) == {"aa", "bb"} and abs(mixed["aa"] - 0.6) < 0.1
    assert language_id.identify(none, model).count() == 0 and language_id.identify(odd, language_id.learn(none)).where("lang_pred <> 'und'").isEmpty()
    assert language_id.identify(odd, language_id.learn(odd)).count() == len(rows)


def test_toxicity(spark, odd, none, rows, labels, no_labels):
    r = random.Random(8)
    bad, groups = ["zorkhead", "grublin", "snarfer"], ["muslim", "jewish", "christian", "hindu"]
    docs = []
    for i in range(900):
        toxic = i % 5 == 0
        words = prose(1000 + i, 40).split()
        for _ in range(2 if toxic else 0):
            words.insert(r.randrange(40), r.choice(bad) + r.choice(["", "!", "."]))
        if r.random() < (0.7 if toxic else 0.1):  # one group is named in toxic texts far more often than in others
            words.insert(r.randrange(40), "Muslim")
        docs.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id bigint, text string")
    rated = spark.createDataFrame([(i, y) for i, _, y in docs if i < 700], "doc_id bigint, toxic int")
    model, plain = toxicity.train(df, rated), toxicity.train(df, rated, swap=0.0)
    held = {x.doc_id: x.score for x in toxicity.score(df.where("doc_id >= 700"), model).collect()}
    assert sum((held[i] >= 0.5) == bool(y) for i, _, y in docs if i >= 700) >= 195
    probes = spark.createDataFrame([(k, f"my neighbour is {g} and kind") for k, g in enumerate(groups)], "doc_id bigint, text string")
    spread = lambda m: float(np.ptp([np.log(x.score / (1 - x.score)) for x in toxicity.score(probes, m).collect()]))
    assert spread(model) < 0.35 * spread(plain)
    assert toxicity.score(none, model).count() == 0 and all(0 <= x.score <= 1 for x in toxicity.score(odd, model).collect())
    assert toxicity.score(odd, toxicity.train(odd, no_labels)).where("score > 0.01").isEmpty() and toxicity.score(odd, toxicity.train(odd, labels)).count() == len(rows)


def test_mixtures_equal_a_grid_search():
    r = np.random.default_rng(5)
    table = r.dirichlet(np.full(64, 0.3), 2) + 1e-4
    table /= table.sum(axis=1, keepdims=True)
    for share in (0.0, 0.25, 0.6, 1.0):
        counts = np.bincount(r.choice(64, 3000, p=share * table[0] + (1 - share) * table[1]), minlength=64).astype(float)
        shares, value = language_id.proportions(table, counts, steps=500)
        grid = [counts @ np.log(x * table[0] + (1 - x) * table[1]) for x in np.linspace(0, 1, 1001)]
        assert abs(shares[0] - np.argmax(grid) / 1000) < 0.02 and abs(value - max(grid)) < 0.5
        grams = np.repeat(np.arange(64), counts.astype(int))
        best = max(counts @ np.log(t) for t in table)
        both = max(grid) - best > language_id.PENALTY * np.log(len(grams) + 1)
        assert (language_id.infer(table, grams) > 0).sum() == (2 if both else 1) and both == (0 < share < 1)


def test_languages_beyond_the_model(spark):
    docs = spark.createDataFrame([(i, "abc def ghi " * (1 + i), f"l{i:03d}") for i in range(40)] + [(99, "x", None)], "doc_id bigint, text string, lang string")
    names, table = language_id.learn(docs, most=5)
    assert names == [f"l{i:03d}" for i in range(35, 40)] and table.shape[0] == 5


def test_weights_make_the_penalised_loss_small():
    """Brute force: no other weights tried have a lower loss, and the loss itself is the plain formula's."""
    r = np.random.default_rng(9)
    n, size = 400, 12
    rows = [np.flatnonzero(r.random(size) < 0.3).astype(np.int32) for _ in range(n)]
    swapped = [np.unique(np.where(x == 0, 1, np.where(x == 1, 0, x))).astype(np.int32) for x in rows]
    label = np.array([float((0 in x) * 0.8 + (3 in x) * 1.2 + r.normal() * 0.4 > 0.9) for x in rows])
    differ = np.array([x.tolist() != y.tolist() for x, y in zip(rows, swapped, strict=True)])
    x, y = toxicity._Csr(rows, size), toxicity._Csr(swapped, size)
    model = toxicity.fit(label, x, y, differ, np.arange(size), steps=3000)
    best = toxicity.loss(label, x, y, differ, model.weights, model.bias)
    z = [sum(model.weights[k] for k in row) + model.bias for row in rows]
    z2 = [sum(model.weights[k] for k in row) + model.bias for row in swapped]
    balance = [((n - label.sum()) / label.sum()) ** 0.5 if t else 1.0 for t in label]
    plain = sum(b * (math.log1p(math.exp(v)) - t * v) for b, v, t in zip(balance, z, label, strict=True)) / sum(balance)
    plain += toxicity.L2 / 2 * sum(w * w for w in model.weights) + sum((a - b) ** 2 for a, b, d in zip(z, z2, differ, strict=True) if d) / differ.sum()
    assert best == pytest.approx(plain)
    for _ in range(300):
        other = model.weights + r.normal(size=size) * r.choice([0.02, 0.1, 0.5])
        assert toxicity.loss(label, x, y, differ, other, model.bias + r.normal() * 0.05) > best
    free = toxicity.fit(label, x, y, differ, np.arange(size), steps=3000, swap=0.0)
    assert abs(model.weights[0] - model.weights[1]) < 0.2 * abs(free.weights[0] - free.weights[1])


def test_places_are_packed_either_way():
    for size, some in ((5000, range(0, 5000, 3)), (5000, [4999]), (5000, []), (3, [0, 2])):
        data = toxicity.packed(np.array(some, np.int64), size)
        assert toxicity.unpacked(data, size).tolist() == list(some) and len(data) <= 1 + max(size // 8 + 1, 4)


def test_sentencepieces(odd, none, rows):
    got = sentencepieces.encode(odd).collect()
    assert len(got) == len(rows) and all(x.lossless for x in got)
    by_text = {t: i for i, t in rows}
    back = sentencepieces.decode(sentencepieces.encode(odd)).collect()
    assert Counter((x.doc_id, x.text) for x in back) == Counter((i, t or "") for i, t in rows) and by_text
    again = sentencepieces.encode(odd.repartition(7)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, tuple(x.ids)) for x in got) == sorted((x.doc_id is None, x.doc_id or 0, tuple(x.ids)) for x in again)
    assert sentencepieces.encode(none).count() == 0


def test_samples_follow_the_lattice():
    p = sentencepieces.load(token_counts.vocabulary(sentencepieces.MODEL))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary(sentencepieces.MODEL))
    weight = {model.id_to_piece(i): (2 - model.get_score(i)) ** -0.5 for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    ways = {}

    def walk(rest, done, value):
        if not rest:
            ways[done] = value
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                walk(rest[n:], (*done, rest[:n]), value * weight[rest[:n]])

    walk("▁tested", (), 1.0)
    n, total = 20_000, sum(ways.values())
    seen = Counter(tuple(model.id_to_piece(int(i)) for i in x) for x in p.encode([" tested"] * n, list(range(n))))
    assert set(seen) <= set(ways) and max(abs(seen[k] / n - v / total) for k, v in ways.items()) < 0.02
    texts = ["a▁ b\n\n  ", "日本語" * 300 + "😀" * 200, " " * 500, "x" * 5000, ""]
    ids = p.encode(texts, list(range(5)))
    assert [p.decode(x) for x in ids] == texts and (p.encode([texts[1]], [1])[0] == ids[1]).all()
