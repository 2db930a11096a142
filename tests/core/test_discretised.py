import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.binning import DimensionSpec, render_spec
from pulsegrid.operators.order import with_index
from pulsegrid.sources import files
from pulsegrid.sources.discretised import DiscretisedSource

SPECS = [DimensionSpec("X", 0.0, 10.0, 1.0), DimensionSpec("y", 0.0, 9.0, -1.0, ((-2.0, 3.0), (3.0, 50.0)))]
LINE = ";".join(render_spec(s, 10 + k) for k, s in enumerate(SPECS))


@pytest.fixture(scope="module")
def series(spark):
    spark.dataSource.register(DiscretisedSource)
    base = {c: (F.col("id") if c in files.WHOLE else F.col("id") / 8) for c in files.LAYOUTS["error"]}
    cols = [c.cast(files.WHOLE.get(n, "double")).alias(n) for n, c in base.items()]
    codes = [(F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 2).cast("int").alias("y")]
    return spark.range(3000).select(F.col("id").alias("idx"), *cols, *codes)


def rows(df, names):
    return sorted(map(tuple, df.select(names).collect()))


@pytest.mark.parametrize("size", [1 << 26, 5000, 97])
def test_round_trip(spark, series, tmp_path, size):
    path = str(tmp_path / "out")
    n = 3000 if size > 97 else 200
    some = series.where(F.col("idx") < n)
    some.repartitionByRange(5, "idx").sortWithinPartitions("idx").write.format("discretised").option("specs", LINE).mode("overwrite").save(path)
    got = spark.read.format("discretised").option("layout", "error").option("partitionBytes", size).load(path)
    names = some.columns
    dense = with_index(got, "position")
    assert rows(dense, names) == rows(some, names)
    assert got.rdd.getNumPartitions() > (1 if size > 5000 else 20)
    back, specs = files.read_discretised(spark, path, "error")
    assert specs == SPECS and rows(back, names) == rows(some, names)


def test_overwrite_and_one_file(spark, series, tmp_path):
    path = str(tmp_path / "out")
    for n in (900, 40):
        series.where(F.col("idx") < n).coalesce(1).write.format("discretised").option("specs", LINE).mode("overwrite").save(path)
    assert spark.read.format("discretised").load(path).count() == 40
    one = tmp_path / "one.txt"
    lines = [r.value for r in files.in_file_order(spark.read.text(path)).orderBy("idx").collect()]
    for tail in ("", "\n", "\n\n\n"):
        one.write_text("\n".join(lines) + tail)
        for size in (60, 1 << 20):
            got = spark.read.format("discretised").option("partitionBytes", size).load(str(one))
            assert sorted(r.iteration for r in got.collect()) == list(range(40))
    one.write_text("\n".join([*lines[:10], "", *lines[10:]]) + "\n")
    with pytest.raises(Exception, match="empty line"):
        spark.read.format("discretised").option("partitionBytes", 1 << 20).load(str(one)).collect()


def test_errors(spark, series, tmp_path):
    with pytest.raises(Exception, match="missing"):
        series.drop("x").write.format("discretised").option("specs", LINE).mode("overwrite").save(str(tmp_path / "a"))
    (tmp_path / "short").write_text("1\n1\n")
    with pytest.raises(Exception, match="no header"):
        spark.read.format("discretised").load(str(tmp_path / "short")).collect()
    (tmp_path / "bad").write_text("1\n1\nx,0,10,1,10\nnames\n1,2\n")
    with pytest.raises(Exception, match="2 fields"):
        spark.read.format("discretised").load(str(tmp_path / "bad")).collect()
    series.limit(0).write.format("discretised").option("specs", LINE).mode("overwrite").save(str(tmp_path / "none"))
    assert spark.read.format("discretised").load(str(tmp_path / "none")).count() == 0
