import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.binning import DimensionSpec
from pulsegrid.sources import files

HEADER = "Iteration,Year,Month,Day,Latitude,Longitude,RelativeError,NOxTheoryppm,AbsError,pass,engrpm,Bkpwr"
LINES = [f"{100 + i},2020,1,{1 + i // 6},45.0,-93.0,{i - 1}.5,{10 * i},{-i if i == 3 else i},{i % 2},{600 + 100 * i},{i - 2}" for i in range(12)]
SPECS = [DimensionSpec("engrpm", 0.0, 5000.0, 500.0), DimensionSpec("Bkpwr", 0.0, 100.0, -1.0, ((0.0, 3.0), (3.0, 50.0)))]


def series(spark, tmp_path):
    (tmp_path / "data.csv").write_text("\n".join(LINES) + "\n")
    (tmp_path / "header.csv").write_text(HEADER + "\n")
    readings = files.read_readings(spark, str(tmp_path / "data.csv"), str(tmp_path / "header.csv"))
    return readings, files.discretise(readings, "error", SPECS)


def test_readings_to_series(spark, tmp_path):
    readings, got = series(spark, tmp_path)
    rows = got.orderBy("idx").collect()
    assert [r.iteration for r in rows] == list(range(100, 112))
    assert rows[0].rel_error == 0 and rows[3].abs_error == 0
    assert [r.engrpm for r in rows] == [(600 + 100 * i) // 500 for i in range(12)]
    assert [r.bkpwr for r in rows] == [int(i - 2 >= 3) for i in range(12)]
    base = files.base_columns(readings, "error")
    assert base.columns == ["idx", *files.LAYOUTS["error"]] and base.count() == 12


def test_text_form_round_trip(spark, tmp_path):
    _, got = series(spark, tmp_path)
    files.write_discretised(got, str(tmp_path / "out"), "error", SPECS)
    back, specs = files.read_discretised(spark, str(tmp_path / "out"), "error")
    assert [s.name for s in specs] == ["engrpm", "Bkpwr"] and specs == SPECS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.select(back.columns).collect()))


def test_parquet_form_round_trip(spark, tmp_path):
    _, got = series(spark, tmp_path)
    files.write_series(got, str(tmp_path / "store"), "error", SPECS)
    back, layout, specs = files.read_series(spark, str(tmp_path / "store"))
    assert layout == "error" and specs == SPECS and back.count() == 12


def test_pattern_table(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a:,b:,Support,Count,Kvalue,IsOver\n.,0 1 1,0.01,1000,2.25,0\n1 1 1,0 1 1,0.005,500,2.5,1\n")
    rows = files.read_pattern_table(spark, str(tmp_path / "p.csv")).orderBy("cnt").collect()
    assert [(r.p_a, r.p_b, r.support, r.cnt, r.k_value, r.is_over) for r in rows] == [("1 1 1", "0 1 1", 0.005, 500, 2.5, 1), (None, "0 1 1", 0.01, 1000, 2.25, 0)]


def test_occurrence_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("3\n7\n9\n1.25\n\n4\n2.5\n8\n")
    got = files.read_occurrence_log(spark, str(tmp_path / "log.txt")).collect()
    assert sorted((r.block, r.start_idx, r.k_value) for r in got) == [(0, 3, 1.25), (0, 7, 1.25), (0, 9, 1.25), (1, 4, 2.5)]


def test_regulation_and_obd(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("\n".join(",".join(str(k + r) for k in range(130)) for r in range(3)) + "\n")
    rows = files.read_regulation(spark, str(tmp_path / "wide.csv")).orderBy("idx").collect()
    assert [(r.iteration, r.brake_power, r.nox_rate, r["pass"]) for r in rows] == [(r, 45.0 + r, 118.0 + r, 128 + r) for r in range(3)]
    (tmp_path / "obd.csv").write_text("a,b,c\n1,2,3\n4,,6\n")
    got = files.read_obd(spark, str(tmp_path / "obd.csv"), ["b", "c"]).orderBy("idx").collect()
    assert [(r.idx, r.b, r.c) for r in got] == [(0, 2.0, 3.0), (1, None, 6.0)]


def test_window_files(spark, tmp_path):
    rows = [(4, 5, 10, 11, "<10,11>"), (1, 2, 7, 8, "<7,8>")]
    windows = spark.createDataFrame(rows, "start_idx long, end_idx long, start_iteration long, end_iteration long, label string")
    files.write_starts(windows, str(tmp_path / "starts"))
    files.write_labels(windows, str(tmp_path / "labels"))
    assert [r.value for r in spark.read.text(str(tmp_path / "starts")).collect()] == ["1", "4"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "labels")).collect()) == ["<10,11>", "<7,8>"]


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_many_files_keep_their_order(spark, tmp_path, split):
    """Files of unequal sizes, and splits inside files; the largest does not come first."""
    spec = [DimensionSpec("x", 0.0, 10.0, 1.0)]
    rows = [(k, k, 2020, 1, 1, 0.0, 0.0, 1.0, 2.0, 3.0, 4, k % 10) for k in range(4000)]
    names = ["idx", *files.LAYOUTS["error"], "x"]
    series = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n in ('latitude', 'longitude', 'rel_error', 'theory', 'abs_error') else 'int'}" for n in names))
    files.write_discretised(series, str(tmp_path / "out"), "error", spec)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        back, specs = files.read_discretised(spark, str(tmp_path / "out"), "error")
        got = back.collect()
        (tmp_path / "raw").mkdir()
        at = 0
        for k, n in enumerate((3, 500, 40, 2000, 1)):
            (tmp_path / "raw" / f"{k}.csv").write_text("\n".join(f"{i},{2 * i}" for i in range(at, at + n)) + "\n")
            at += n
        readings = files.read_readings(spark, str(tmp_path / "raw"), ["iteration", "b"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert specs == spec and len(got) == 4000 and all(r.idx == r.iteration and r.x == r.idx % 10 for r in got)
    assert len(readings) == at and all(r.idx == r.iteration and r.b == 2 * r.idx for r in readings)


@pytest.mark.parametrize("layout", list(files.LAYOUTS))
def test_every_layout_round_trips(spark, tmp_path, layout):
    base = files.LAYOUTS[layout]
    whole = {"iteration", "year", "month", "day", "pass"}
    raw = {v: k for k, v in files.ALIASES.items()}
    rows = [tuple([k if c in whole else k - 2.5 for c in base] + [k - 2.0, k - 2.0]) for k in range(6)]
    schema = ", ".join(f"{raw.get(c, c)} {'int' if c in whole else 'double'}" for c in base) + ", NOxTheoryDim double, other double"
    readings = spark.createDataFrame(rows, schema).withColumn("idx", F.col("iteration").cast("long"))
    specs = [DimensionSpec("other", -5.0, 5.0, -1.0, ((-3.0, -1.0), (-1.0, 1e-05), (1e-05, 4.0)))]
    got = files.discretise(readings, layout, specs)
    files.write_discretised(got, str(tmp_path / "out"), layout, specs)
    back, read = files.read_discretised(spark, str(tmp_path / "out"), layout)
    assert read == specs and sorted(map(tuple, back.collect())) == sorted(map(tuple, got.select(back.columns).collect()))
    clipped = files.CLIPPED[layout]
    for r in got.collect():
        assert all((r[c] >= 0) if c in clipped else r[c] == r.idx - 2.5 for c in base if c not in whole)


def test_clip_lists_differ_by_layout(spark):
    def code(layout, name):
        base = {c: F.lit(1) for c in files.LAYOUTS[layout]}
        df = spark.range(1).withColumnRenamed("id", "idx").withColumns(base | {name: F.lit(-7.0)})
        return files.discretise(df, layout, [DimensionSpec(name, -10.0, 10.0, 1.0)]).first()[name]

    assert code("error", "noxtheoryppm") == 10 and code("co2", "noxtheoryppm") == 3
    assert code("error", "scroutppm") == 3 and code("co2", "scroutppm") == 10 and code("model", "scroutppm") == 10
    assert code("model", "scringps") == 10 and code("error", "speed") == 3


@pytest.mark.parametrize("gap", [0, 3, 700, 1999, 2000])
@pytest.mark.parametrize("split", ["128m", "3k"])
def test_a_file_ends_at_its_first_empty_line(spark, tmp_path, gap, split):
    """In the first, a middle and the last split; a second empty line and what follows play no part; other files do."""
    lines = [f"{k},{2 * k}" for k in range(2000)]
    text = "\n".join([*lines[:gap], "", *lines[gap : gap + 900], "", "no numbers"]) + "\n"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "0.csv").write_text(text)
    (tmp_path / "raw" / "1.csv").write_text("90000,1\n90001,2\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = files.read_readings(spark, str(tmp_path / "raw"), ["iteration", "b"]).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.idx for r in got] == list(range(gap + 2))
    assert [r.iteration for r in got] == [*range(gap), 90000, 90001]


def test_discretised_file_with_empty_lines(spark, tmp_path):
    head = ["3", "1", "x,0,10,1,10", ",".join([*files.LAYOUTS["error"], "x"])]
    rows = [f"{k},2020,1,1,0.0,0.0,1.0,2.0,3.0,4,{k}" for k in range(3)]
    for name, lines, n in (("end", [*rows, "", ""], 3), ("middle", [*rows[:2], "", rows[2]], 2), ("none", ["", *rows], 0)):
        (tmp_path / name).write_text("\n".join([*head, *lines]) + "\n")
        back, specs = files.read_discretised(spark, str(tmp_path / name), "error")
        assert [(r.idx, r.x) for r in back.orderBy("idx").collect()] == [(k, k) for k in range(n)] and specs[0].name == "x"


def test_broken_lines_are_errors(spark, tmp_path):
    for k, bad in enumerate(("1,x", "1")):
        (tmp_path / f"{k}.csv").write_text(f"0,1\n{bad}\n")
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            files.read_readings(spark, str(tmp_path / f"{k}.csv"), ["iteration", "b"]).collect()


@pytest.mark.parametrize("text", ["v,0,10,1,5,1-2#x-4#6-7", "v,0,10,1,5,1-2,3-4", "v,0,10,1,5-", "v,0,10,1,1-2#", "v,0,10,1,five", "v,0"])
def test_broken_specs_are_errors(text):
    from pulsegrid.functions.binning import parse_spec

    with pytest.raises(ValueError):
        parse_spec(text)


def test_whole_specs():
    from pulsegrid.functions.binning import parse_spec

    assert parse_spec("v,0,10,1,5,-3--1#-1-2.5e1").intervals == ((-3.0, -1.0), (-1.0, 25.0))
    assert parse_spec("v, 0, 10, 1, 1-2").intervals == ((1.0, 2.0),) and parse_spec("v,0,10,1,12").intervals == () == parse_spec("v,0,10,1,12,").intervals


def test_occurrence_log_round_trip(spark, tmp_path):
    rows = [("1 1", None, 7, 2.0), ("1 1", None, 30, 2.0), ("1 1", "0 0", 4, 1.25), (None, "0 0", 9, 1.25), (None, "0 0", 2, 1.25)]
    log = spark.createDataFrame(rows, "p_a string, p_b string, start_idx long, k_value double")
    files.write_occurrence_log(log, str(tmp_path / "log"))
    lines = [r.value for r in files.in_file_order(spark.read.text(str(tmp_path / "log"))).orderBy("idx").collect()]
    assert lines == ["7", "30", "2.0", "2", "9", "1.25", "4", "1.25"]
    got = files.read_occurrence_log(spark, str(tmp_path / "log")).collect()
    assert sorted((r.block, r.start_idx, r.k_value) for r in got) == [(0, 7, 2.0), (0, 30, 2.0), (1, 2, 1.25), (1, 9, 1.25), (2, 4, 1.25)]
    files.write_occurrence_log(log.limit(0), str(tmp_path / "none"))
    assert files.read_occurrence_log(spark, str(tmp_path / "none")).count() == 0
