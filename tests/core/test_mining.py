import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions.rules import WindowRule, model_rule
from pulsegrid.operators import patterns, windows
from pulsegrid.operators.order import in_chunks, with_index
from tests.core import brute

SCHEMA = "idx long, iteration long, year int, month int, day int, pass int, abs_error double, theory double, a int, b int, c int, d int, e int"
RULE = WindowRule("abs_standard", 3, standard=5, guard=None)


def make(n, seed=1, dims="abcde"):
    rng, rows, it = random.Random(seed), [], 0
    for i in range(n):
        it += 1 if rng.random() > 0.05 else 3
        rows.append(
            {"idx": i, "iteration": it, "year": 1, "month": 1, "day": i // 25, "pass": i // 12 % 2, "abs_error": float(rng.randint(-1, 12)), "theory": 1.0}
            | {d: rng.randint(0, 1 + k % 3) for k, d in enumerate(dims)}
        )
    return rows


def frame(spark, rows):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], SCHEMA)


def flagged(rows, n=3):
    return brute.windows(rows, n, lambda w: sum(r["abs_error"] for r in w) > 0 and sum(r["abs_error"] for r in w) / n > 5)


def mined(df, dims):
    return {tuple(r[f"p_{d}"] for d in dims): (r.cnt, r.join_cnt, r.distinct_join, r.k_value) for r in df.collect()}


@pytest.mark.parametrize(("n", "length", "lag", "dims"), [(120, 3, 1, "abc"), (90, 2, 3, "ab"), (60, 1, 0, "abc")])
def test_mining_equals_enumeration(spark, n, length, lag, dims):
    rows = make(n)
    config = patterns.MiningConfig(RULE, tuple(dims), lag=lag, k_threshold=1.0, min_support=0.02, lengths=(length,), chunk_rows=17)
    want = brute.mine(rows, flagged(rows), dims, length, lag, 0.02, 1.0)
    assert mined(patterns.mine(frame(spark, rows), config), dims) == want and want


def test_chunks_levels_and_order_of_dimensions_change_nothing(spark):
    rows = frame(spark, make(300, 7))
    base = patterns.MiningConfig(RULE, tuple("abcde"), lag=2, k_threshold=1.0, min_support=0.02, chunk_rows=None, strategy="cube")
    want = mined(patterns.mine(rows, base), "abcde")
    assert want
    for other in (replace(base, chunk_rows=40), replace(base, strategy="levelwise"), replace(base, dimensions=tuple("edcba"))):
        assert mined(patterns.mine(rows, other), "abcde") == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000), st.integers(0, 3), st.integers(1, 4))
def test_measures_keep_their_bounds(spark, seed, lag, length):
    rows = make(80, seed)
    config = patterns.MiningConfig(RULE, ("a", "b"), lag=lag, k_threshold=0.0, lengths=(length,), chunk_rows=23)
    found = patterns.candidates(frame(spark, rows), config).collect()
    counts = {(r.p_a, r.p_b): r for r in found}
    for r in found:
        assert 0 <= r.distinct_join <= min(r.join_cnt, r.cnt) and r.join_cnt <= r.cnt * (lag + 1)
        assert 0 < r.support <= 1 and 0 <= r.confidence <= 1
        for sub in ((r.p_a, None), (None, r.p_b)):
            if sub in counts and sub != (r.p_a, r.p_b):
                assert counts[sub].cnt >= r.cnt and counts[sub].join_cnt >= r.join_cnt


def test_candidates_by_range_and_by_rows_agree(spark):
    rows = make(200, 5)
    got = windows.candidate_starts(frame(spark, rows), RULE, 2, chunk_rows=31)
    want = brute.candidates(rows, set(flagged(rows)), 2)
    assert {r.idx for r in got.collect()} == want
    marked = windows.flag(frame(spark, rows), RULE, chunk_rows=31).withColumn("near", windows.candidate(2))
    assert {r.idx for r in marked.where("near").collect()} == want


def test_no_window_gives_no_pattern(spark):
    rows = frame(spark, make(50))
    config = patterns.MiningConfig(replace(RULE, standard=1e9), ("a", "b"), lengths=(2,))
    assert patterns.mine(rows, config).count() == 0
    assert patterns.mine(rows.limit(0), config).count() == 0
    assert patterns.occurrence_log(rows, config).count() == 0


def test_tiny_series_by_hand(spark):
    rows = [
        {"idx": i, "iteration": it, "year": 1, "month": 1, "day": 1, "pass": p, "abs_error": e, "theory": 1.0, "a": a, "b": 0, "c": 0, "d": 0, "e": 0}
        for i, (it, p, e, a) in enumerate([(1, 0, 9.0, 1), (2, 0, 9.0, 1), (3, 0, 9.0, 2), (5, 0, 9.0, 1), (6, 1, 9.0, 1), (7, 1, 9.0, 1), (8, 1, 0.0, 2)])
    ]
    df = frame(spark, rows)
    assert [r.start_idx for r in windows.listing(df, RULE).orderBy("start_idx").collect()] == [0, 4]
    got = mined(patterns.mine(df, patterns.MiningConfig(RULE, ("a",), lag=0, k_threshold=0, lengths=(2,))), "a")
    assert got == {("1 1",): (3, 2, 2, 7 * 2 / (3 * 2))}  # the offset at 3 crosses the run and counts


def test_bad_configurations():
    with pytest.raises(ValueError):
        WindowRule("abs_standard", 3)
    with pytest.raises(ValueError):
        WindowRule("nothing", 3, standard=1)
    for kind in ("model_error", "model_under", "model_over"):
        with pytest.raises(ValueError):
            WindowRule(kind, 3, standard=5)
    with pytest.raises(ValueError):
        model_rule(2, 3, 50)
    assert [model_rule(t, 3, 50).kind for t in (-1, 0, 1)] == ["model_under", "model_error", "model_over"]
    for kind in ("abs_standard", "rel_standard", "rel_standard_guarded", "specific_nox", "specific_co2"):
        with pytest.raises(ValueError):
            WindowRule(kind, 3, percent=5)
    with pytest.raises(ValueError):
        patterns.MiningConfig(RULE, ())
    with pytest.raises(ValueError):
        patterns.MiningConfig(RULE, ("a",), lag=-1)
    with pytest.raises(ValueError):
        patterns.MiningConfig(RULE, ("a",), strategy="best")


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("key"), F.col("id").alias("other"))
    got = with_index(df.unionByName(df.limit(3)), "key", "other", range_rows=90).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1003))
    assert [r.key for r in got] == sorted(r.key for r in got)


def test_a_chunk_must_outlast_its_frames(spark):
    with pytest.raises(ValueError):
        in_chunks(spark.range(3).withColumnRenamed("id", "idx"), 5, lambda o: {}, 5)


def test_cuts_below(spark):
    from pulsegrid.operators.order import cuts_below

    for n in (0, 1, 2, 7, 16, 30):
        cuts = [3 * k for k in range(n)]
        df = spark.range(-2, 100).select(F.col("id"), cuts_below(F.col("id"), cuts).alias("n"))
        assert all(r.n == sum(c < r.id for c in cuts) for r in df.collect())
    null = spark.range(1).select(cuts_below(F.lit(None).cast("long"), [1, 2]).alias("n"))
    assert null.first().n == 0
