"""How often a fit goes over its rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import fits
from pulsegrid.operators.tables import shared_dir


def noisy(spark, groups=2, n=600):
    rng = np.random.default_rng(5)
    x = rng.uniform(1, 5, n)
    y = 3e6 * x**1.5 * rng.uniform(0.99, 1.01, n)
    return spark.createDataFrame([(k % groups, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_rows_are_made_once_and_let_go(spark, keys):
    """Whatever leads to the rows is run once, however many steps the fit takes."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    df = noisy(spark).withColumn("x", counted("x").alias("x")).repartition(2)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    got = fits.fit_power_law(df.select("g", "x", "y"), "y", ["x"], keys).collect()
    assert made.value <= 2 * 600 and sum(r.n for r in got) == 600  # once in the filter, once in the column
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_a_fit_ends_where_only_rounding_is_left(spark, monkeypatch):
    """A step that is worse by rounding alone is the end, not a reason for more damping; the fit is no worse for it."""
    solved = fits._normal_equations
    calls = []

    def noisy_sums(rows, keys, gradient, residual):
        """Sums as they come in another order: the loss is a little higher each time."""
        calls.append(1)
        return solved(rows, keys, gradient, residual).withColumn("loss", F.col("loss") * (1 + 1e-14 * len(calls)))

    df = noisy(spark)
    plain = fits.fit_power_law(df, "y", ["x"]).first()
    monkeypatch.setattr(fits, "_normal_equations", noisy_sums)
    got = fits.fit_power_law(df, "y", ["x"]).first()
    assert len(calls) <= 10
    assert (got.a, got.b, got.rmse) == pytest.approx((plain.a, plain.b, plain.rmse), rel=1e-7)
