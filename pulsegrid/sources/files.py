"""Text formats of sensor logs and mining results."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from pulsegrid.functions.binning import DimensionSpec, clip, event_code, parse_spec, render_spec

WHOLE = {"iteration": LongType(), "year": IntegerType(), "month": IntegerType(), "day": IntegerType(), "pass": IntegerType()}
#: Base columns of the layouts, in order; the event codes follow them.
LAYOUTS: dict[str, tuple[str, ...]] = {
    "error": ("iteration", "year", "month", "day", "latitude", "longitude", "rel_error", "theory", "abs_error", "pass"),
    "specific": ("iteration", "year", "month", "day", "latitude", "longitude", "nox_ppm", "nox_rate", "brake_power", "pass"),
    "co2": ("iteration", "year", "month", "day", "latitude", "longitude", "co2_rate", "brake_power", "pass"),
    "model": ("iteration", "year", "month", "day", "latitude", "longitude", "pass", "sensor", "model", "rel_error", "abs_error"),
}
#: Base columns whose negatives count as 0, for each layout.
CLIPPED: dict[str, tuple[str, ...]] = {
    "error": ("rel_error", "theory", "abs_error"),
    "specific": (),
    "co2": ("co2_rate",),
    "model": ("sensor",),
}
#: Ordinals of the regulation layout in a wide raw file.
REGULATION = {0: "iteration", 2: "year", 3: "month", 4: "day", 8: "latitude", 9: "longitude", 45: "brake_power", 112: "nox_ppm", 118: "nox_rate", 128: "pass"}
#: What raw files call the base columns, in lower case.
ALIASES = {
    "relativeerror": "rel_error", "noxtheoryppm": "theory", "abserror": "abs_error", "absoluteerror": "abs_error", "scroutppm": "nox_ppm",
    "scroutgps": "nox_rate", "bkpwr": "brake_power", "co2gps": "co2_rate", "scrinppm": "sensor", "noxbymodel": "model",
}
#: Dimensions whose negatives count as 0 before binning, for each layout.
_RATES = frozenset({"scroutgps", "bkpwr", "scrinppm", "scringps"})
CLIPPED_DIMENSIONS: dict[str, frozenset[str]] = {
    "error": _RATES | {"noxtheoryppm"},
    "specific": _RATES | {"scroutppm"},
    "co2": _RATES | {"scroutppm"},
    "model": _RATES | {"scroutppm"},
}
#: Splits of files whose offsets are broadcast at most.
BROADCAST_SPLITS = 100_000


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a headerless file, from the single line of another; in lower case."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return [c.strip().lower() for c in line[0].split(",")]


def read_readings(spark: SparkSession, data: str, header: str | Sequence[str]) -> DataFrame:
    """A headerless file of readings, in file order: ``idx`` and the named columns.

    A file ends at its first empty line.  Several files follow one another by name.  In the columns that are used, a
    field that is no number is an error, as is a line that is too short for them.
    """
    names = read_header(spark, header) if isinstance(header, str) else [h.lower() for h in header]
    schema = ", ".join(f"`{n}` {WHOLE.get(n, DoubleType()).simpleString()}" for n in names)
    lines = in_file_order(spark.read.text(data), ends=F.col("value") == "")
    return lines.select("idx", F.from_csv("value", schema, {"mode": "FAILFAST"}).alias("r")).select("idx", "r.*")


def in_file_order(read: DataFrame, ends: Column | None = None) -> DataFrame:
    """What was read, and ``idx`` by position: file name, place of the split in the file, row in the split.

    ``ends`` marks rows at the first of which a file ends: it and what follows it in the file are left out.

    Spark deals the splits of a read by size, so the order of partitions is not that of the files.  Rows of a
    split lie together in one task; the counts of the splits are summed in file order, a row for each split.
    """
    rows = read.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    end = F.lit(None).cast("long") if ends is None else F.when(ends, F.col("__at"))
    splits = rows.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__at").alias("__first"), F.min(end).alias("__end"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max(F.col("__end").isNotNull()).over(before), F.lit(False))
    last = F.when(over, F.col("__first")).otherwise(F.coalesce("__end", F.col("__first") + F.col("n")))
    splits = splits.withColumn("__last", last)  # of the split, the first row that is left out
    ahead = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = F.coalesce(F.sum(F.col("__last") - F.col("__first")).over(ahead), F.lit(0))
    offsets = splits.select("__file", "__block", (sums - F.col("__first")).alias("__offset"), "__last")
    # a partition holds one split that fills it, or several smaller ones, which end their files
    if len(read.inputFiles()) + read.rdd.getNumPartitions() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    rows = rows.join(offsets, ["__file", "__block"]).where("__at < __last")
    return rows.withColumn("idx", F.col("__at") + F.col("__offset")).drop("__file", "__block", "__at", "__offset", "__last")


def read_regulation(spark: SparkSession, data: str) -> DataFrame:
    """The regulation columns of a wide headerless file without quotes, by ordinal; it ends at its first empty line."""
    fields = F.split("value", ",")
    cols = [F.get(fields, k).cast(WHOLE.get(n, DoubleType())).alias(n) for k, n in REGULATION.items()]
    return in_file_order(spark.read.text(data), ends=F.col("value") == "").select("idx", *cols)


def base_columns(readings: DataFrame, layout: str) -> DataFrame:
    """Readings with the base columns under their own names, negatives clipped as the layout asks."""
    lower = {ALIASES.get(c.lower(), c.lower()): c for c in readings.columns}
    missing = [c for c in LAYOUTS[layout] if c not in lower]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    cols = {c: clip(F.col(lower[c])) if c in CLIPPED[layout] else F.col(lower[c]) for c in LAYOUTS[layout]}
    return readings.select("idx", *[c.alias(n) for n, c in cols.items()])


def discretise(readings: DataFrame, layout: str, specs: Sequence[DimensionSpec], strict: bool = True) -> DataFrame:
    """idx, the base columns of the layout and an event code for each dimension, named in lower case."""
    lower = {c.lower(): c for c in readings.columns}
    base = {ALIASES.get(c, c): c for c in lower}
    cols = []
    for c in LAYOUTS[layout]:
        if c not in base:
            raise ValueError(f"column is missing: {c}")
        value = F.col(lower[base[c]])
        cols.append((clip(value) if c in CLIPPED[layout] else value).alias(c))
    for s in specs:
        value = F.col(lower[s.name.lower()])
        value = clip(value) if s.name.lower() in CLIPPED_DIMENSIONS[layout] else value
        cols.append(event_code(s, value, strict).alias(s.name.lower()))
    return readings.select("idx", *cols)


def write_series(series: DataFrame, path: str, layout: str, specs: Sequence[DimensionSpec]) -> None:
    """Parquet, and beside it the dimensions and the layout as JSON."""
    series.write.mode("overwrite").parquet(f"{path}/series")
    spec = json.dumps({"layout": layout, "dimensions": [asdict(s) for s in specs]})
    series.sparkSession.createDataFrame([(spec,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def read_series(spark: SparkSession, path: str) -> tuple[DataFrame, str, list[DimensionSpec]]:
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    dims = [DimensionSpec(**(d | {"intervals": tuple(map(tuple, d["intervals"]))})) for d in spec["dimensions"]]
    return spark.read.parquet(f"{path}/series"), spec["layout"], dims


def write_discretised(series: DataFrame, path: str, layout: str, specs: Sequence[DimensionSpec]) -> None:
    """The text form: row count, number of dimensions, dimensions, header, then the rows in order."""
    base = LAYOUTS[layout]
    names = [*base, *[s.name.lower() for s in specs]]
    described = ";".join(render_spec(s, len(base) + k) for k, s in enumerate(specs))
    head = [str(series.count()), str(len(specs)), described, ",".join(names)]
    spark = series.sparkSession
    lines = series.select((F.col("idx") + len(head)).alias("n"), F.concat_ws(",", *[F.col(n).cast("string") for n in names]).alias("value"))
    first = spark.createDataFrame(list(enumerate(head)), "n long, value string")
    both = first.unionByName(lines).repartitionByRange("n").sortWithinPartitions("n")
    both.select("value").write.mode("overwrite").text(path)


def read_discretised(spark: SparkSession, path: str, layout: str) -> tuple[DataFrame, list[DimensionSpec]]:
    """(idx, base columns, codes; the dimensions) of the text form, up to its first empty line."""
    lines = in_file_order(spark.read.text(path), ends=F.col("value") == "")
    head = [r["value"] for r in lines.where("idx < 4").orderBy("idx").collect()]
    if len(head) < 4:
        raise ValueError(f"{path} has no header")
    specs = [parse_spec(s) for s in head[2].split(";")]
    if len(specs) != int(head[1]):
        raise ValueError(f"{path} names {len(specs)} dimensions, not {head[1]}")
    fields = F.split("value", ",")
    names = [*LAYOUTS[layout], *[s.name.lower() for s in specs]]
    types = [WHOLE.get(n, DoubleType()) for n in LAYOUTS[layout]] + [IntegerType()] * len(specs)
    cols = [F.get(fields, k).cast(t).alias(n) for k, (n, t) in enumerate(zip(names, types))]
    return lines.where("idx >= 4").select((F.col("idx") - 4).alias("idx"), *cols), specs


def write_starts(windows: DataFrame, path: str) -> None:
    """First indexes of flagged windows, one a line."""
    windows.select(F.col("start_idx").cast("string")).sort(F.col("start_idx").cast("long")).write.mode("overwrite").text(path)


def write_labels(windows: DataFrame, path: str) -> None:
    """``<first,last>`` iterations of flagged windows, one a line."""
    windows.sort("start_idx").select("label").write.mode("overwrite").text(path)


def read_pattern_table(spark: SparkSession, path: str) -> DataFrame:
    """Published patterns: p_<dimension> (null where the table has a dot), support, cnt, k_value, is_over."""
    raw = spark.read.csv(path, header=True)
    fixed = {"Support": ("support", DoubleType()), "Count": ("cnt", LongType()), "Kvalue": ("k_value", DoubleType()), "IsOver": ("is_over", IntegerType())}
    dims = [c for c in raw.columns if c not in fixed]
    cols = [F.when(F.col(f"`{c}`") != ".", F.col(f"`{c}`")).cast(StringType()).alias(f"p_{c.rstrip(':').lower()}") for c in dims]
    return raw.select(*cols, *[F.col(c).cast(t).alias(n) for c, (n, t) in fixed.items()])


def read_occurrence_log(spark: SparkSession, path: str) -> DataFrame:
    """block, start_idx, k_value of a log that lists the starts of each pattern and then its cross-K.

    A line written as a fraction ends a block, ``2.0`` too.  Blocks are numbered through sums over ranges of lines.
    """
    lines = in_file_order(spark.read.text(path).where("trim(value) <> ''")).select("idx", "value", F.col("value").cast("double").alias("v"))
    rows = lines.withColumn("ends", (~F.col("value").rlike(r"^\s*[+-]?[0-9]+\s*$")).cast("long")).withColumn("part", F.floor(F.col("idx") / 100_000))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("ends").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, "part").withColumn("block", F.col("before") + F.coalesce(F.sum("ends").over(within), F.lit(0)))
    ks = rows.where("ends = 1").select("block", F.col("v").alias("k_value"))
    return rows.where("ends = 0").select("block", F.col("v").cast("long").alias("start_idx")).join(ks, "block")


def write_occurrence_log(log: DataFrame, path: str) -> None:
    """``log`` (a pattern's columns, start_idx, k_value) in its text form: the starts of each pattern, then its cross-K.

    Patterns come by falling cross-K, then by their own columns.  Lines are dealt by ranges of this order and sorted in
    their tasks, so a pattern with many starts is spread over files, which follow one another by name.
    """
    keys = [c for c in log.columns if c not in ("start_idx", "k_value")]
    end = log.select(*keys, "k_value").distinct().withColumns({"start_idx": F.lit(None).cast("long"), "__last": F.lit(1)})
    rows = log.select(*keys, "k_value", "start_idx", F.lit(0).alias("__last")).unionByName(end)
    order = [F.col("k_value").desc(), *[F.col(c).asc_nulls_first() for c in keys], F.col("__last"), F.col("start_idx")]
    # a cross-K without a fraction would read as a start: written as a decimal number it still has one
    line = F.when(F.col("__last") == 1, F.col("k_value").cast("double").cast("string")).otherwise(F.col("start_idx").cast("string"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def read_obd(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a file with a header, as doubles, in file order."""
    raw = spark.read.csv(path, header=True)
    return in_file_order(raw).select("idx", *[F.col(c).cast("double").alias(c) for c in columns])
