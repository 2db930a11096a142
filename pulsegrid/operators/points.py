"""Rows around pattern occurrences: expansion, complement, samples, shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.operators.order import CHUNK_ROWS, in_chunks, join_few


def slice_rows(series: DataFrame, start: int, rows: int = 60) -> DataFrame:
    return series.where(F.col("idx").between(start, start + rows - 1))


def expand(starts: DataFrame, rows: int) -> DataFrame:
    """The distinct indexes start .. start + rows - 1 of every start_idx."""
    each = F.explode(F.sequence(F.col("start_idx"), F.col("start_idx") + rows - 1)).alias("idx")
    return starts.select(each).distinct()


def expand_after(starts: DataFrame, rows: int, keys: list[str]) -> DataFrame:
    """For each pattern (``keys``) the points start .. start + rows - 1 that are no start of it and lie before
    its last start; a point that two occurrences reach comes twice."""
    last = starts.groupBy(*keys).agg(F.max("start_idx").alias("__last"))
    each = F.explode(F.sequence(F.col("start_idx"), F.col("start_idx") + rows - 1)).alias("idx")
    points = starts.select(*keys, each)
    taken = starts.select(*keys, F.col("start_idx").alias("idx"))

    same = points["idx"] == taken["idx"]
    for k in keys:
        same = same & points[k].eqNullSafe(taken[k])
    points = points.join(taken, same, "left_anti")
    return join_few(points, last, keys, by="idx").where("idx < __last").select(*keys, "idx")


def complement(series: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of ``series`` that are none of the points."""
    return series.join(points.select("idx"), "idx", "left_anti")


def members(series: DataFrame, points: DataFrame) -> DataFrame:
    return series.join(points.select("idx"), "idx", "left_semi")


def without_nan(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))


def lead_last_repeated(series: DataFrame, name: str, out: str, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The next row's value; the last row keeps its own."""

    def add(order: WindowSpec) -> dict[str, Column]:
        return {out: F.coalesce(F.lead(name, 1).over(order), F.col(name))}

    return in_chunks(series, 1, add, chunk_rows)


def divergence(theory: Column, actual: Column) -> Column:
    """``positive`` where theory is at least the actual value."""
    return F.when(theory >= actual, "positive").when(theory < actual, "negative")


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "idx") -> DataFrame:
    """n rows at random: those least by a hash of ``key`` with ``seed``, so a rerun gets the same."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(n)


def sample_windows(series: DataFrame, n: int, length: int, seed: int) -> DataFrame:
    """n random windows of ``length`` rows that end inside the series: start_idx, end_idx."""
    fits = series.where(F.col("idx") + length <= series.count())
    return sample_rows(fits, n, seed).select(F.col("idx").alias("start_idx"), (F.col("idx") + length - 1).alias("end_idx"))


def sample_flagged(windows: DataFrame, n: int, seed: int) -> DataFrame:
    """Of n draws with replacement from the listed windows, the distinct ones; none of an empty listing."""
    total = windows.count()
    spark = windows.sparkSession
    if not total:
        return windows.limit(0)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary")), 1, 8), 16, 10).cast("long")
    draws = spark.range(n).select(F.pmod(drawn, F.lit(total)).alias("__rank")).distinct()
    from pulsegrid.operators.order import with_index

    ranked = with_index(windows, "start_idx").withColumnRenamed("idx", "__rank")
    return ranked.join(F.broadcast(draws), "__rank", "left_semi").drop("__rank")  # n rows at most


def train_test(series: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rest, the rows named by ``test``)."""
    return complement(series, test), members(series, test)
