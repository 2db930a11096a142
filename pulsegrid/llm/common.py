"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.tables import materialise, release, shared_dir  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: A key is a hub when it has more than one in HUBS of all rows, so there are never more hubs than that.
HUBS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z only; other scripts keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of text that a Python worker gets at once; Spark's own default is 64 MB, of which JVM and worker hold copies.
BATCH_BYTES = "4m"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, unless the session has a bound of its own."""
    if spark.conf.get(_BATCHES, "64m") in ("64m", "64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCHES, BATCH_BYTES)


def join_on_key(rows: DataFrame, values: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """``rows`` with the columns of ``values``: one row for each key and ``n``, how many of ``total`` rows have it.

    Hubs, at most ``HUBS`` of them, are broadcast and their rows stay where they are; of any other key a task
    gets at most one in ``HUBS`` of all rows.
    """
    hub = F.col(n) > F.lit(total / HUBS)
    hubs, others = F.broadcast(values.where(hub).drop(n)), values.where(~hub).drop(n)
    rest = rows.join(hubs.select(key), key, "left_anti").join(others, key)
    return rows.join(hubs, key).unionByName(rest)
