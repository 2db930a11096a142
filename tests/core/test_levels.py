"""Level-wise counting, packed keys, postings and window pairs against plain loops."""

from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import levels, patterns, postings, windows
from pulsegrid.operators.packed import Layout, codecs, texts
from tests.core import brute
from tests.core.test_mining import RULE, flagged, frame, make, mined

WIDE = patterns.MiningConfig(RULE, tuple("abcde"), lag=1, k_threshold=1.0, min_support=0.02, chunk_rows=40, strategy="levelwise")


@pytest.fixture(scope="module")
def rows():
    return make(300, 7)


@pytest.fixture(scope="module")
def series(spark, rows):
    return frame(spark, rows).persist()


def by_length(found, dims, length):
    return mined(found.where(F.col("pattern_len") == length), dims)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_lengths_extend_one_another(spark, rows, series, broadcast, monkeypatch):
    """Prefixes, suffixes and sub-patterns prune, and nothing is lost; consecutive lengths or not."""
    monkeypatch.setattr(levels, "BROADCAST_PATTERNS", broadcast)
    for lengths in ((1, 2, 3), (2, 4)):
        found = patterns.mine(series, replace(WIDE, lengths=lengths))
        for n in lengths:
            assert by_length(found, "abcde", n) == brute.mine(rows, flagged(rows), "abcde", n, 1, 0.02, 1.0)


def test_candidates_keep_all_with_support(rows, series):
    config = replace(WIDE, lengths=(2, 3), k_threshold=1.5)
    found = patterns.candidates(series, config)
    for n in (2, 3):
        assert by_length(found, "abcde", n) == brute.mine(rows, flagged(rows), "abcde", n, 1, 0.02, float("-inf"))


def test_within_run_levels(series):
    base = replace(WIDE, lengths=(2, 3), within_run=True)
    one = mined(patterns.mine(series, replace(base, strategy="cube")), "abcde")
    assert one and mined(patterns.mine(series, base), "abcde") == one


@pytest.mark.parametrize("k", [1, 7, 40, 10_000])
def test_best_patterns_by_a_rising_threshold(series, k):
    report, plain = [], []
    found = patterns.mine_top(series, replace(WIDE, k_threshold=0.5), k, report)
    want = patterns.top_k(patterns.mine(series, replace(WIDE, k_threshold=0.5, strategy="cube")), k)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]
    patterns.candidates_of(series, [WIDE], report=plain)
    if k == 1:
        assert sum(r.expanded for r in report) < sum(r.expanded for r in plain)


def test_report_counts_rows_expanded(rows, series):
    """A key for each row and set all of whose subsets of one less are frequent, near a window, and can pass."""
    n, length, least, w = len(rows), 3, 6, len(flagged(rows))
    near, flags = brute.candidates(rows, set(flagged(rows)), 1), set(flagged(rows))
    key = lambda i, s: (s, tuple(tuple(r[d] for d in s) for r in rows[i : i + length]))
    starts, alive, want = range(n - length + 1), None, []
    for size in range(1, 6):
        made = [(i, s) for s in combinations("abcde", size) for i in starts if alive is None or all(key(i, x) in alive for x in combinations(s, size - 1))]
        if not made:
            break
        count, join, cand = {}, {}, set()
        for i, s in made:
            k = key(i, s)
            count[k] = count.get(k, 0) + 1
            join[k] = join.get(k, 0) + (i in flags) + (i + 1 in flags)
            if i in near:
                cand.add(k)
        frequent = {k for k in count if count[k] >= least}
        alive = {k for k in frequent & cand if n * join[k] / (least * w) > 1.0}
        want.append((size, len(made), len(frequent), len(alive)))
    got = patterns.level_report(series, WIDE).orderBy("n_dims").collect()
    assert [(r.n_dims, r.n_expanded, r.n_frequent, r.n_extended) for r in got] == [x for x in want if x[1]]


def test_several_rules_and_lags_together(series):
    configs = [replace(WIDE, strategy=s, lag=lag, rule=replace(RULE, standard=t), k_threshold=k) for s in ("cube",) for lag, t, k in ((0, 5, 1.0), (2, 5, 1.2), (1, 7, 0.9))]
    for strategy in ("cube", "levelwise"):
        own = [replace(c, strategy=strategy) for c in configs]
        found = patterns.mine_all(series, own)
        for v, c in enumerate(own):
            assert mined(found.where(F.col("variant") == v), "abcde") == mined(patterns.mine(series, c), "abcde")
    with pytest.raises(ValueError):
        patterns.mine_all(series, [configs[0], replace(configs[0], lengths=(2,))])


def test_codes_of_any_range(spark):
    """Wide ranges take several longs, texts a dictionary, and a null is a code of its own."""
    rows = [{**r, "a": (r["a"] - 1) * 10**9, "b": None if i % 7 == 0 else r["b"] * 5 - 3} for i, r in enumerate(make(120, 3))]
    df = frame(spark, rows).withColumn("a", F.col("a").cast("long") * 1_000_003).withColumn("c", F.concat(F.lit("it's "), "c"))
    shown = [{**r, "a": r["a"] * 1_000_003, "b": "?" if r["b"] is None else r["b"], "c": f"it's {r['c']}"} for r in rows]
    for strategy in ("cube", "levelwise"):
        config = patterns.MiningConfig(RULE, tuple("abc"), lag=1, k_threshold=0.5, min_support=0.02, lengths=(3,), chunk_rows=50, strategy=strategy)
        assert mined(patterns.mine(df, config), "abc") == brute.mine(shown, flagged(rows), "abc", 3, 1, 0.02, 0.5)
    coded = codecs(df, ["a", "b", "c"])
    assert len(coded[0].parts(3)) == 3 and len(coded[1].parts(3)) == 1
    layout = Layout(coded, 3, [("a",), ("a", "b")])
    assert len(layout.keys) > 1
    with pytest.raises(ValueError):
        codecs(spark.range(2).selectExpr("if(id = 0, -9000000000000000000L, 9000000000000000000L) AS z"), ["z"])


def test_keys_turn_back_into_texts(spark):
    df = spark.createDataFrame([(k, k % 3 - 1, k % 5) for k in range(15)], "idx long, a int, b int")
    coded = codecs(df, ["a", "b"])
    packed = df.withColumns({c.columns(1)[0]: c.digit() for c in coded})
    sets = [("a",), ("b",), ("a", "b")]
    layout = Layout(coded, 1, sets)
    for n, s in enumerate(sets):
        keyed = packed.select("a", "b", F.expr(layout.key(n)).alias("k0"))
        for r in keyed.select("a", "b", *layout.words()).select("a", "b", *texts(coded, 1)).collect():
            assert (r.p_a, r.p_b) == (str(r.a) if "a" in s else None, str(r.b) if "b" in s else None)


def test_nothing_stays_cached(spark, series):
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    patterns.mine(series, replace(WIDE, lengths=(2, 3))).count()
    patterns.mine(series, replace(WIDE, strategy="cube")).count()
    patterns.occurrence_log(series, replace(WIDE, strategy="cube", dimensions=("a",))).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_pattern_window_pairs(rows, series):
    config = replace(WIDE, dimensions=("a", "b"), lag=4, strategy="cube", lengths=(2,))
    kept = patterns.mine(series, config)
    pairs = patterns.window_pairs(patterns.occurrence_log(series, config, kept), windows.listing(series, RULE, 40).select("start_idx"), 4)
    counted = {(r.p_a, r.p_b): r.n for r in pairs.groupBy("p_a", "p_b").agg(F.count("*").alias("n")).collect()}
    assert counted == {(r.p_a, r.p_b): r.join_cnt for r in kept.where("join_cnt > 0").collect()}
    flags = set(flagged(rows))
    for r in pairs.collect():
        assert r.window_start in flags and 0 <= r.window_start - r.start_idx <= 4
    assert pairs.distinct().count() == pairs.count()


def test_wide_bins_are_cut(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BIN_ROWS", 3)
    log = spark.createDataFrame([(s, "x") for s in (0, 2, 5, 9, 11)], "start_idx long, p_a string")
    flags = spark.createDataFrame([(w,) for w in (0, 1, 4, 9, 12, 18)], "start_idx long")
    got = sorted((r.start_idx, r.window_start) for r in patterns.window_pairs(log, flags, 7).collect())
    assert got == sorted((s, w) for s in (0, 2, 5, 9, 11) for w in (0, 1, 4, 9, 12, 18) if s <= w <= s + 7)
    assert patterns.window_pairs(log.limit(0), flags, 7).isEmpty() and patterns.window_pairs(log, flags.limit(0), 7).isEmpty()


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_postings_count_without_the_series(spark, rows, series, tmp_path, block):
    index = postings.postings(series, "abc", 40, block)
    asked = [{"a": (0, 1)}, {"a": (1, 1, 0), "c": (2, 1, 0)}, {"b": (0, 0, 0, 0), "a": (1, 0, 1, 0)}, {"a": (9, 9)}, {"a": (0,) * 20}]
    asked += [{d: tuple(r[d] for r in rows[i : i + 6]) for d in "abc"} for i in range(0, 60, 11)]
    want = [[i for i in range(len(rows)) if all(len(rows[i : i + len(c)]) == len(c) and [r[d] for r in rows[i : i + len(c)]] == list(c) for d, c in p.items())] for p in asked]
    assert [r.cnt for r in postings.lookup(index, asked, block).orderBy("pattern").collect()] == [len(x) for x in want]
    at = [set() for _ in asked]
    for r in postings.positions(index, asked, block).collect():
        at[r.pattern] |= {r.block * block + x for x in r.offsets}
    assert at == [set(x) for x in want]
    assert index.agg(F.max(F.size("offsets"))).first()[0] <= block
    if block == 1 << 16:
        postings.write_postings(series, str(tmp_path / "index"), "abc", 40)
        stored = postings.read_postings(spark, str(tmp_path / "index"))
        assert [r.cnt for r in postings.lookup(stored, asked).orderBy("pattern").collect()] == [len(x) for x in want]


@pytest.mark.parametrize("pattern", [{"a": (1,)}, {}, {"a": ()}, {"a": (1, 2), "b": (1,)}])
def test_patterns_without_transitions_are_refused(series, pattern):
    with pytest.raises(ValueError):
        postings.lookup(postings.postings(series, "ab", 40), [pattern])
