"""An event table as a measurement series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.order import with_index

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by id: idx, iteration, the run (year, month, day, pass), measures in whole hundredths, codes d0-d6."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.lit(False), 0)
    for n, name in enumerate(EVENT_TYPES):
        kind = kind.when(F.col("event_type") == name, n)
    rows = events.select(
        "event_id", F.col("event_id").alias("iteration"), F.year("ts").alias("year"), F.month("ts").alias("month"),
        F.dayofmonth("ts").alias("day"), F.floor(F.hour("ts") / 6).cast("int").alias("pass"),
        cents.alias("err"), k.alias("k"),
        (F.col("value") / 50).cast("int").alias("d0"), F.floor(F.hour("ts") / 8).cast("int").alias("d1"), kind.alias("d2"),
        F.floor(k / 25).cast("int").alias("d3"), F.floor(F.col("user_id") / 50).cast("int").alias("d4"),
        (F.col("event_id") % 3).cast("int").alias("d5"), (F.col("event_id") % 2).cast("int").alias("d6"),
    )
    named = {n: F.col("err") for n in ("abs_error", "rel_error", "theory", "nox_rate", "nox_ppm", "co2_rate", "sensor")}
    return with_index(rows, "event_id").withColumns(named | {"brake_power": F.col("k"), "model": F.col("k") * 100}).drop("event_id")
