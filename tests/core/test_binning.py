import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.binning import DimensionSpec, clip, event_code, parse_spec, render_spec


def codes(spark, spec, values, strict=True):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double")
    return [r.c for r in df.select(event_code(spec, F.col("v"), strict).alias("c")).collect()]


def test_equal_width_truncates_toward_zero(spark):
    assert codes(spark, DimensionSpec("x", 10, 20, 5), [10, 14.9, 15, 30, 9, 4, 0, None]) == [0, 0, 1, 4, 0, -1, -2, None]


def test_explicit_intervals(spark):
    spec = DimensionSpec("x", intervals=((-5, 0), (0, 10), (20, 30)))
    assert codes(spark, spec, [-5, -0.1, 0, 9.99, 20, None]) == [0, 0, 1, 1, 2, None]
    assert codes(spark, spec, [10, 15, 30, -6], strict=False) == [None] * 4
    with pytest.raises(Exception, match="no interval holds"):
        codes(spark, spec, [15])


def test_hybrid(spark):
    spec = DimensionSpec("x", 0, 100, 12, ((30, 45), (45, 90)))
    assert codes(spark, spec, [0, 11.9, 12, 29.9, 30, 44.9, 45, 89.9, 90, 101.9, 102]) == [0, 0, 1, 2, 3, 3, 4, 4, 5, 5, 6]
    gap = DimensionSpec("x", 0, 100, 10, ((30, 40), (50, 60)))
    assert codes(spark, gap, [45, 55, 60], strict=False) == [None, 4, 5]


def test_clip(spark):
    df = spark.createDataFrame([(-1.5,), (0.0,), (2.0,), (None,)], "v double")
    assert [r.c for r in df.select(clip(F.col("v")).alias("c")).collect()] == [0.0, 0.0, 2.0, None]


def test_specs_are_read_and_written():
    for spec in (DimensionSpec("x", 0.0, 9.0, 1.5), DimensionSpec("y", 0.0, 9.0, -1.0, ((0.0, 1.0), (2.0, 3.5)))):
        assert parse_spec(render_spec(spec, 10)) == spec
    assert parse_spec("x,0,9,1.5") == DimensionSpec("x", 0.0, 9.0, 1.5)
    with pytest.raises(ValueError):
        parse_spec("x,1")
    with pytest.raises(ValueError):
        DimensionSpec("x")
    with pytest.raises(ValueError):
        DimensionSpec("x", intervals=((0, 2), (1, 3)))


def test_specs_are_read_back_as_written():
    for pairs in (((-3.0, -1.0), (-1.0, 2.5)), ((0.0, 1e-05), (1e-05, 1e300)), ((-1e-07, -1e-09),), ((-float("inf"), 0.0),)):
        spec = DimensionSpec("x", -3.5, 1e9, -1.0, pairs)
        assert parse_spec(render_spec(spec, 11)) == spec
    assert parse_spec("x,0,1,0.5,7").intervals == ()
    assert parse_spec("x,0,1,-1,-2--1#-1-3").intervals == ((-2.0, -1.0), (-1.0, 3.0))
