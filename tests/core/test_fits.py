import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import features as phys
from pulsegrid.operators import fits, points
from pulsegrid.plans import queries


def test_known_parameters_are_recovered(spark, small):
    one = queries.powerlaw_fit(spark, small).collect()[0]
    assert one.a == pytest.approx(25e5, rel=0.2) and one.b == pytest.approx(-1.5, abs=0.02) and one.c == pytest.approx(0.5, abs=0.01)
    four = queries.powerlaw_fit_oxygen(spark, small).collect()[0]
    assert four.d == pytest.approx(2.0, abs=0.02)
    each = queries.powerlaw_fit_per_pattern(spark, small).collect()
    assert len(each) == 5 and all(abs(r.c - 0.5) < 0.02 for r in each) and sum(r.n for r in each) == 1000


def test_least_squares_are_in_the_target(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 5, 400)
    y = 3 * x**2 + rng.normal(0, 2, 400)
    y = np.maximum(y, 0.1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = fits.fit_power_law(df, "y", ["x"]).collect()[0]
    loss = lambda a, b: float(((y - a * x**b) ** 2).sum())
    best = loss(got.a, got.b)
    assert got.rmse == pytest.approx(math.sqrt(best / 400), rel=1e-9)
    for da, db in ((1.001, 1), (0.999, 1), (1, 1.001), (1, 0.999)):
        assert loss(got.a * da, got.b * db) >= best


def test_exact_laws_in_closed_form(spark):
    """Without noise the fit is the law; of two points each, it is the line through their logarithms."""
    rows = [(g, x, z, a * x**b * z**c) for g, (a, b, c) in enumerate([(3.0, 2.0, -1.0), (1e6, -0.5, 0.25), (1e-5, 0.1, 3.0)]) for x in (1.0, 2.0, 3.5, 7.0) for z in (0.5, 1.5, 4.0)]
    got = fits.fit_power_law(spark.createDataFrame(rows, "g int, x double, z double, y double"), "y", ["x", "z"], ["g"]).orderBy("g").collect()
    for r, (a, b, c) in zip(got, [(3.0, 2.0, -1.0), (1e6, -0.5, 0.25), (1e-5, 0.1, 3.0)]):
        assert (r.a, r.b, r.c) == pytest.approx((a, b, c), rel=1e-6) and r.n == 12 and r.rmse < 1e-6 * a * 1e3
    two = [(k, 1.0 + k, 5.0 + k, 2.0 + k, 11.0 * (k + 1)) for k in range(3)]
    df = spark.createDataFrame([(k, x, y) for k, a, b, p, q in two for x, y in ((a, p), (b, q))], "k int, x double, y double")
    for r, (_, a, b, p, q) in zip(fits.fit_power_law(df, "y", ["x"], ["k"]).orderBy("k").collect(), two):
        slope = math.log(q / p) / math.log(b / a)
        assert r.b == pytest.approx(slope, rel=1e-6) and r.a == pytest.approx(p / a**slope, rel=1e-6)


def test_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(fits, "MOST_GROUPS", 2)
    with pytest.raises(ValueError):
        fits.fit_power_law(spark.range(9).selectExpr("id AS k", "1.0D + id AS x", "2.0D + id AS y"), "y", ["x"], ["k"])


def test_empty_fit(spark):
    df = spark.createDataFrame([(-1.0, 2.0)], "x double, y double")
    assert fits.fit_power_law(df, "y", ["x"]).count() == 0


def test_scores_and_p_value(spark):
    rows = [(float(k), 2.0 * k + (k % 3)) for k in range(50)]
    got = fits.scores(spark.createDataFrame(rows, "a double, p double"), "a", "p").collect()[0]
    a, p = np.array(rows).T
    assert got.r2 == pytest.approx(np.corrcoef(a, p)[0, 1] ** 2)
    assert got.rmse == pytest.approx(math.sqrt(((a - p) ** 2).mean())) and got.mae == pytest.approx(abs(a - p).mean())


def by_integration(r2, n, steps=2_000_000):
    """With t = sqrt(v) tan(s) the density of Student's t is a power of a cosine."""
    s = np.linspace(math.atan(math.sqrt(r2 / (1 - r2))), math.pi / 2, steps + 1)
    logs = (n - 3) * np.log(np.maximum(np.cos(s), 1e-300))
    return 2 * np.trapezoid(np.exp(logs + math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2) - math.log(math.pi) / 2), s)


def test_p_value_equals_integration(spark):
    cases = [(0.2, 12), (0.0, 30), (1e-9, 1000), (0.9, 5), (0.5, 3), (0.3, 4), (0.001, 1000), (0.002, 5000), (0.02, 100_000), (0.999, 40), (0.08, 33)]
    got = spark.createDataFrame(cases, "r2 double, n long").select("r2", "n", fits.p_value(F.col("r2"), F.col("n")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(by_integration(r.r2, r.n), rel=1e-7), (r.r2, r.n)
    odd = spark.createDataFrame([(1.0, 30), (None, 9), (0.5, 2), (0.5, 0)], "r2 double, n long").select(fits.p_value(F.col("r2"), F.col("n")).alias("p")).collect()
    assert odd[0].p == 0 and odd[1].p is None and math.isnan(odd[2].p) and math.isnan(odd[3].p)
    plan = fits.scores(spark.range(3).selectExpr("id % 2 AS k", "cast(id AS double) AS a"), "a", "a", ["k"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_flame_temperature_solves_the_balance(spark):
    df = spark.createDataFrame([(0.6, 300.0), (0.9, 330.0)], "r double, t double")
    cols = [phys.flame_temperature(F.col("r"), F.col("t")), phys.nitrogen_moles(F.col("r")), phys.oxygen_moles(F.col("r")), phys.peak_temperature(F.col("t"))]
    for flame, n2, o2, peak in df.select(*cols).collect():
        rise, moles = flame - peak, (phys.CO2_MOLES, phys.WATER_MOLES, n2, o2)
        heat = phys.GAS_CONSTANT * sum(m * (a * rise + b / 2 * rise**2) for m, a, b in zip(moles, phys.HEAT_LINEAR, phys.HEAT_QUADRATIC))
        assert heat == pytest.approx(phys.HEATING_VALUE * phys.FUEL_MOLE, rel=1e-9)


def test_points(spark, small):
    starts = spark.createDataFrame([("x", 1), ("x", 3), ("x", 9), (None, 4)], "p_a string, start_idx long")
    assert sorted(r.idx for r in points.expand(starts, 2).collect()) == [1, 2, 3, 4, 5, 9, 10]
    after = points.expand_after(starts, 3, ["p_a"]).collect()
    assert sorted((r.p_a or "", r.idx) for r in after) == [("x", 2), ("x", 4), ("x", 5)]
    sample = queries.sample_windows(spark, small)
    rows = sample.collect()
    assert len(rows) == 20 and all(0 <= r.start_idx and r.end_idx < 1000 and r.end_idx - r.start_idx + 1 == r.length for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sample.collect()))
    flagged = queries.sample_flagged_windows(spark, small).collect()
    assert 1 <= len(flagged) <= 10
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert points.without_nan(nan, "v").count() == 1
    series = spark.range(10).withColumnRenamed("id", "idx")
    rest, chosen = points.train_test(series, spark.createDataFrame([(3,), (4,)], "idx long"))
    assert rest.count() == 8 and chosen.count() == 2
