"""The engine's queries over ``events``, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import features as phys
from pulsegrid.functions.binning import DimensionSpec, clip, event_code
from pulsegrid.functions.rules import WindowRule
from pulsegrid.operators import fits, patterns, points, postings, windows
from pulsegrid.operators.order import with_index
from pulsegrid.operators.tables import materialise
from pulsegrid.sources.events import event_series

DIMS = ("d0", "d1", "d2")
WIDE_DIMS = ("d0", "d1", "d2", "d3", "d4")
#: Windows whose mean lies above 60.00; the series holds hundredths.
BAD = WindowRule("abs_standard", 3, standard=6000, guard=None)
MINING = patterns.MiningConfig(BAD, DIMS, lag=1, k_threshold=1.0, min_support=0.004, lengths=(3,))
WIDE = replace(MINING, dimensions=WIDE_DIMS)
SEVEN = replace(MINING, dimensions=(*WIDE_DIMS, "d5", "d6"))

RULES: dict[str, WindowRule] = {
    "windows_abs_std": WindowRule("abs_standard", 3, standard=5000, guard=30000),
    "windows_abs_all_rows": WindowRule("abs_every_row", 3, standard=2000, percent=1000, guard=30000),
    "windows_rel_std": WindowRule("rel_standard", 3, standard=5000, guard=30000),
    "windows_rel_increase_sum": WindowRule("rel_increase_sum", 3, standard=20000, percent=50, guard=30000),
    "windows_rel_increase_avg": WindowRule("rel_increase_avg", 3, standard=5000, percent=50, guard=30000),
    "windows_rel_guard40": WindowRule("rel_standard_guarded", 3, standard=3000, guard=20000),
    "windows_theory_increase": WindowRule("theory_increase", 3, percent=50, guard=30000),
    "windows_brake_specific": WindowRule("specific_nox", 3, standard=300000, guard=30000),
    "windows_brake_specific_increase": WindowRule("specific_nox_increase", 3, standard=300000, percent=50, guard=30000),
    "windows_co2_specific": WindowRule("specific_co2", 3, standard=300000),
    "windows_co2_specific_increase": WindowRule("specific_co2_increase", 3, percent=50),
    "windows_model_error_all": WindowRule("model_error", 3, percent=50),
    "windows_model_error_under": WindowRule("model_under", 3, percent=50),
    "windows_model_error_over": WindowRule("model_over", 3, percent=50),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _listing(rule: WindowRule) -> Query:
    return lambda spark, sf_dir: windows.listing(event_series(spark, sf_dir), rule)


QUERIES |= {name: _listing(rule) for name, rule in RULES.items()}


def _idle(rule: WindowRule) -> Query:
    """The rule where brake power is below zero about as often as above."""
    return lambda spark, sf_dir: windows.listing(event_series(spark, sf_dir).withColumn("brake_power", F.col("k") - 50), rule)


QUERIES["windows_brake_specific_idle"] = _idle(WindowRule("specific_nox_increase", 3, percent=50, guard=30000))
QUERIES["windows_co2_specific_idle"] = _idle(WindowRule("specific_co2_increase", 3, standard=300000, percent=50))


# --- discretisation


def _code(spark: SparkSession, sf_dir: str, spec: DimensionSpec) -> DataFrame:
    value = clip(F.col("err") / 100 - 20)
    return event_series(spark, sf_dir).select("idx", event_code(spec, value).alias("code"))


@query
def discretize_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir, DimensionSpec("value", -10, 500, 7.5))


@query
def discretize_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir, DimensionSpec("value", intervals=((-1, 1), (1, 40), (40, 80), (80, 1e9))))


@query
def discretize_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir, DimensionSpec("value", 0, 500, 12, ((30, 45), (45, 90))))


@query
def discretize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.functions.binning import as_text

    return event_series(spark, sf_dir).select("idx", as_text(F.col("err")).alias("code"))


# --- windows


@query
def window_counts_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [replace(RULES["windows_rel_std"], length=n) for n in (2, 3, 5, 10)]
    return windows.counts_by_length(event_series(spark, sf_dir), rules)


@query
def candidate_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.candidate_starts(event_series(spark, sf_dir), BAD, lag=2)


@query
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.transitions(event_series(spark, sf_dir), DIMS)


@query
def transition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.transition_index(event_series(spark, sf_dir), "d2")


#: Ad hoc patterns, by dimension.
LOOKED_UP = (
    {"d0": (1, 1)}, {"d2": (4, 0, 2)}, {"d0": (0, 1, 0), "d1": (1, 1, 1)}, {"d0": (1, 0), "d1": (2, 2), "d2": (4, 4)},
    {"d1": (0, 0, 0, 0, 0)}, {"d1": (0, 2, 0)},
)


@query
def pattern_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often ad hoc patterns occur, from a stored index of transitions."""
    index = materialise(postings.postings(event_series(spark, sf_dir), DIMS), "postings")
    return postings.lookup(index, LOOKED_UP)


@query
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.slice_rows(event_series(spark, sf_dir), 500, 60).select("idx", "iteration", "err")


# --- patterns


@query
def patterns_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.mine(event_series(spark, sf_dir), MINING)


@query
def patterns_levelwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.mine(event_series(spark, sf_dir), WIDE)


@query
def patterns_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven dimensions, level by level: only rows whose smaller patterns can still count are expanded."""
    return patterns.mine(event_series(spark, sf_dir), SEVEN)


@query
def patterns_topk_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best of seven dimensions, with a threshold that rises from level to level."""
    return patterns.mine_top(event_series(spark, sf_dir), SEVEN, 100)


@query
def pattern_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.level_report(event_series(spark, sf_dir), SEVEN)


@query
def patterns_len_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths 2 to 4 of five dimensions; a longer sequence is counted where its shorter ones go on."""
    return patterns.mine(event_series(spark, sf_dir), replace(WIDE, lengths=(2, 3, 4)))


@query
def singleton_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.candidates(event_series(spark, sf_dir), MINING).where("n_dims = 1")


@query
def patterns_topk20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.top_k(patterns_cube(spark, sf_dir), 20)


@query
def patterns_topk100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.top_k(patterns_cube(spark, sf_dir), 100)


@query
def patterns_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.top_k(patterns_cube(spark, sf_dir), 4)


@query
def patterns_ranked_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.ranked_by_k(patterns_cube(spark, sf_dir))


@query
def patterns_ranked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.ranked_by_join(patterns_cube(spark, sf_dir))


@query
def patterns_len_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.mine(event_series(spark, sf_dir), replace(MINING, lengths=(2, 3, 4)))


@query
def patterns_lag_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    lags = (0, 1, 3)
    found = patterns.mine_all(series, [patterns.with_lag(MINING, n) for n in lags])
    return found.withColumn("lag", F.get(F.array(*[F.lit(n) for n in lags]), F.col("variant"))).drop("variant")


@query
def patterns_short_lag3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = replace(BAD, length=2)
    config = replace(MINING, rule=rule, lag=3, lengths=(2,), min_support=0.002, k_threshold=1.2)
    return patterns.mine(event_series(spark, sf_dir), config)


@query
def patterns_within_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.mine(event_series(spark, sf_dir), replace(MINING, within_run=True))


@query
def patterns_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    kinds = ("all", "under", "over")
    found = patterns.mine_all(series, [replace(MINING, rule=RULES[f"windows_model_error_{kind}"]) for kind in kinds])
    return found.withColumn("error_type", F.get(F.array(*[F.lit(k) for k in kinds]), F.col("variant"))).drop("variant")


@query
def crossk_avg_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.k_statistics(patterns.candidates(event_series(spark, sf_dir), MINING))
    return found.select("pattern_len", "n_candidates", F.round("avg_k", 6).alias("avg_k"), F.round("std_k", 6).alias("std_k"))


@query
def pattern_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.size_metrics(event_series(spark, sf_dir), MINING)


@query
def pattern_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns_cube(spark, sf_dir)
    return found.select(patterns.pattern_text(found).alias("pattern"), "cnt", "k_value")


@query
def pattern_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    return patterns.occurrence_log(series, MINING, patterns.top_k(patterns.mine(series, MINING), 20))


@query
def pattern_window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of the top twenty patterns with each flagged window that it joins, for a lag of 3 rows."""
    series = event_series(spark, sf_dir)
    config = patterns.with_lag(MINING, 3)
    log = patterns.occurrence_log(series, config, patterns.top_k(patterns.mine(series, config), 20))
    return patterns.window_pairs(log, windows.listing(series, BAD).select("start_idx"), 3)


@query
def pattern_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the top twenty patterns, its blocks numbered by rank, cut by cross-K and share of its lines."""
    log = pattern_occurrences(spark, sf_dir)
    names = patterns.names_of(log)
    ranked = log.groupBy("k_value", *names).agg(F.count("*").alias("n")).withColumn("__k", -F.col("k_value"))
    blocks = with_index(ranked, "__k", *[F.col(c).asc_nulls_first() for c in names])  # twenty rows
    blocks = blocks.select(F.col("idx").alias("block"), *[F.col(c).alias(f"__{c}") for c in names])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]
    numbered = log.join(F.broadcast(blocks), same).select("block", "start_idx", "k_value")
    return patterns.filter_log(numbered, 1.4, 0.05)


@query
def pattern_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    flagged = F.sum(F.col("is_anom").cast("long"))
    n, w = windows.flag(series, BAD).agg(F.count("*"), flagged).first()
    return patterns.report(patterns.mine(series, MINING), n, w or 0).select("report", "cnt")


@query
def pattern_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.expand(windows.listing(event_series(spark, sf_dir), BAD), 5)


@query
def pattern_points_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.complement(event_series(spark, sf_dir), pattern_points(spark, sf_dir)).select("idx")


@query
def pattern_points_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of the top four patterns that are themselves flagged, expanded to what follows them."""
    series = event_series(spark, sf_dir)
    log = patterns.occurrence_log(series, MINING, patterns.top_k(patterns.mine(series, MINING), 4))
    flagged = windows.listing(series, BAD).select("start_idx")
    keys = [c for c in log.columns if c.startswith("p_")]
    return points.expand_after(log.join(flagged, "start_idx", "left_semi").select(*keys, "start_idx"), 3, keys)


# --- samples and shifts


@query
def lead_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.lead_last_repeated(event_series(spark, sf_dir), "err", "err_lead").select("idx", "err", "err_lead")


@query
def divergence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    label = points.divergence(F.col("model"), F.col("sensor")).alias("label")
    return series.select(label).groupBy("label").agg(F.count("*").alias("n"))


@query
def sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    both = [points.sample_windows(series, 10, n, seed).withColumn("length", F.lit(n)) for n, seed in ((5, 1), (15, 2))]
    return both[0].unionByName(both[1])


@query
def sample_flagged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.sample_flagged(windows.listing(event_series(spark, sf_dir), BAD), 10, 3)


@query
def sample_other_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.sample_rows(pattern_points_complement(spark, sf_dir), 30_000, 4)


# --- physics


def engine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plausible engine from the series: intake, air, fuel, recirculation, rail, speed, nox."""
    e, k = F.col("err"), F.col("k")
    return event_series(spark, sf_dir).select(
        "idx", "d2",
        phys.kelvin((e % 400) / 10.0).alias("intake_k"), phys.pascal(100 + k / 2.0).alias("intake_pa"),
        (200 + (e % 1000) / 5.0).alias("air"), (5 + k / 20.0).alias("fuel"), (10 + (e % 97) / 9.0).alias("egr"),
        (60 + k / 2.0).alias("rail"), (800.0 + (e % 1500)).alias("rpm"), (0.01 + (e % 713) / 5000.0).alias("nox_gps"),
    )


@query
def features_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("intake_k"), F.col("intake_pa")
    return engine_rows(spark, sf_dir).select(
        "idx", F.round(phys.peak_temperature(t), 6).alias("t_peak"), F.round(phys.peak_pressure(t, p), 3).alias("p_peak"),
        F.round(phys.equivalence_ratio(F.col("air"), F.col("fuel")), 6).alias("ratio"),
    )


@query
def features_oxygen(spark: SparkSession, sf_dir: str) -> DataFrame:
    air, fuel, egr = F.col("air"), F.col("fuel"), F.col("egr")
    return engine_rows(spark, sf_dir).select(
        "idx", F.round(phys.exhaust_oxygen(air, fuel, egr), 6).alias("x_exh"), F.round(phys.cylinder_oxygen(air, fuel, egr), 6).alias("x_o2")
    )


@query
def features_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rail, p = F.col("rail"), F.col("intake_pa")
    time = phys.injection_time(F.col("fuel"), rail, p, F.col("rpm"))
    rate = phys.injection_rate(rail, p)
    return engine_rows(spark, sf_dir).select("idx", F.round(rate, 8).alias("rate"), F.round(time, 8).alias("t_inj"))


def _flame() -> tuple:
    ratio = phys.equivalence_ratio(F.col("air"), F.col("fuel"))
    return ratio, phys.flame_temperature(ratio, F.col("intake_k"))


@query
def features_flame(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, flame = _flame()
    index = phys.emission_index(F.col("nox_gps"), F.col("fuel"))
    return engine_rows(spark, sf_dir).select("idx", F.round(flame, 5).alias("t_flame"), F.round(index, 6).alias("ei_nox"))


@query
def features_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio, _ = _flame()
    ppm = phys.index_to_ppm(phys.emission_index(F.col("nox_gps"), F.col("fuel")), F.col("fuel"), ratio)
    return engine_rows(spark, sf_dir).select("idx", F.round(ppm, 5).alias("ppm"))


@query
def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fits.scores(event_series(spark, sf_dir), "sensor", "model", ["d2"])
    return found.select("d2", "n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae", "p_value")])


@query
def pattern_min_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    base = series.select("idx", F.col("model").alias("predicted"))
    flagged = pattern_points(spark, sf_dir)
    other = series.join(flagged, "idx", "left_semi").select("idx", F.col("sensor").alias("predicted"))
    return fits.min_merge(base, other)


@query
def predictions_recombined(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = event_series(spark, sf_dir)
    over, under = F.col("model") >= F.col("sensor"), F.col("model") < F.col("sensor")
    return fits.recombine(
        series.where(over).select("idx", F.col("sensor").alias("predicted")),
        series.where(under).select("idx", F.col("model").alias("predicted")),
    )


def _fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose target follows a known law, with a little deterministic noise."""
    _, flame = _flame()
    time = phys.injection_time(F.col("fuel"), F.col("rail"), F.col("intake_pa"), F.col("rpm")) * 1000
    x_o2 = phys.cylinder_oxygen(F.col("air"), F.col("fuel"), F.col("egr"))
    rows = engine_rows(spark, sf_dir).select("idx", "d2", flame.alias("flame"), time.alias("time"), x_o2.alias("x_o2"))
    noise = 1 + (F.col("idx") % 7 - 3) / 1000.0
    law = phys.power_law((25e5, -1.5, 0.5), F.col("flame"), F.col("time"))
    wide = phys.power_law((25e5, -1.5, 0.5, 2.0), F.col("flame"), F.col("time"), F.col("x_o2"))
    return rows.withColumn("y", law * noise).withColumn("y_wide", wide * noise)


@query
def powerlaw_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.fit_power_law(_fit_rows(spark, sf_dir), "y", ["flame", "time"])


@query
def powerlaw_fit_oxygen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.fit_power_law(_fit_rows(spark, sf_dir), "y_wide", ["flame", "time", "x_o2"])


@query
def powerlaw_fit_by_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit where the law lies at or above the noisy value, one where it lies below."""
    rows = _fit_rows(spark, sf_dir)
    law = phys.power_law((25e5, -1.5, 0.5), F.col("flame"), F.col("time"))
    return fits.fit_power_law(rows.withColumn("side", points.divergence(law, F.col("y"))), "y", ["flame", "time"], ["side"])


@query
def powerlaw_fit_per_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.fit_power_law(_fit_rows(spark, sf_dir), "y", ["flame", "time"], ["d2"])
