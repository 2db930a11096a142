"""A dense global order, and window frames over it that need no single partition.

Every frame of this library looks forward a bounded number of rows.  So the series is cut into chunks by
``idx``; each chunk also gets the first rows of the next one (its halo), window functions run inside a chunk,
and the halo rows are dropped again.  That is exact and spreads over as many tasks as there are chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a chunk, without its halo: small enough to spread a short series over the tasks there are.
CHUNK_ROWS = 10_000
#: Rows of a key range while the dense order is assigned, about; and ranges at most.
RANGE_ROWS = 12_500
MAX_RANGES = 10_000
#: Ranges that are asked for together with the count of the rows.
FIRST_RANGES = 64


def cuts_below(value: Column, cuts: Sequence[int | float]) -> Column:
    """How many of the ascending ``cuts`` lie below ``value``; 0 of a null.

    Searched in two levels, so that a row is compared with about twice the square root of their number.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    groups = [list(cuts[k : k + step]) for k in range(0, len(cuts), step)]
    last = F.array(*[F.lit(g[-1]) for g in groups])
    whole = F.size(F.filter(last, lambda c: c < value))
    within = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), whole)
    part = F.coalesce(F.size(F.filter(within, lambda c: c < value)), F.lit(0))  # null above the last group
    return F.when(value.isNull(), 0).otherwise(F.least(whole * step + part, F.lit(len(cuts))))


def with_index(df: DataFrame, key: str, *ties: str | Column, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``idx``: 0, 1, 2 ... by ``key`` (numeric), then ``ties``.

    Rows are numbered inside ranges of the key between approximate quantiles, on top of the rows in the ranges below;
    the driver sees a cut and a count for each range.  A null key comes first.
    """

    def quantiles(parts: int) -> Column:
        return F.percentile_approx(key, [k / parts for k in range(1, parts)], 20 * parts)

    seen = df.agg(F.count("*").alias("n"), quantiles(FIRST_RANGES).alias("q")).first()
    parts = min(MAX_RANGES, max(1, seen["n"] // range_rows))
    cuts: list = []
    if parts > FIRST_RANGES:
        cuts = sorted(set(df.select(quantiles(parts).alias("q")).first()["q"]))
    elif parts > 1:
        step = FIRST_RANGES // parts
        cuts = sorted(set((seen["q"] or [])[step - 1 :: step]))
    rows = df.withColumn("__range", cuts_below(F.col(key), cuts))
    ahead, offsets = 0, []
    if cuts:
        counts = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count("*").alias("n")).collect()}
        for k in range(len(cuts) + 1):
            offsets.append(ahead)
            ahead += counts.get(k, 0)
    within = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first(), *ties)
    idx = F.row_number().over(within).cast("long") - 1
    if cuts:
        idx = idx + F.get(F.array(*[F.lit(n) for n in offsets]), F.col("__range")).cast("long")
    return rows.withColumn("idx", idx).drop("__range")


def in_chunks(
    series: DataFrame,
    ahead: int,
    add: Callable[[WindowSpec], dict | list[dict]],
    chunk_rows: int | None = CHUNK_ROWS,
    keep_chunk: bool = False,
) -> DataFrame:
    """``series`` (with dense ``idx``) and the columns that ``add`` makes from an ordered window.

    ``add`` may look at most ``ahead`` rows forward; of several dicts each may use the columns of those before
    it, and ``ahead`` bounds them together.  With ``chunk_rows`` None one partition orders all rows.  With
    ``keep_chunk`` the column ``__chunk`` stays, by which the result is dealt: what is grouped by it needs no shuffle.
    """
    if chunk_rows is not None and ahead >= chunk_rows:
        raise ValueError("a chunk must be longer than what a frame looks ahead")
    if chunk_rows is None:
        rows = series.withColumn("__chunk", F.lit(0).cast("long")) if keep_chunk else series
        order = Window.orderBy("idx")
    else:
        chunk = F.floor(F.col("idx") / F.lit(chunk_rows)).cast("long")
        starts = (F.col("idx") % F.lit(chunk_rows) < F.lit(ahead)) & (F.col("idx") >= F.lit(chunk_rows))
        both = F.when(starts, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
        rows = series.withColumn("__own", chunk).withColumn("__chunk", F.explode(both))
        order = Window.partitionBy("__chunk").orderBy("idx")
    steps = add(order)
    for step in steps if isinstance(steps, list) else [steps]:
        rows = rows.withColumns(step)
    if chunk_rows is None:
        return rows
    return rows.where("__own = __chunk").drop("__own", *[] if keep_chunk else ["__chunk"])


#: Parts into which the rows of one key are dealt by ``join_few``.
SALTS = 8


def join_few(rows: DataFrame, few: DataFrame, on: Sequence[str], by: str) -> DataFrame:
    """``rows`` joined with ``few``, a row for each key ``on`` (nulls are a key of their own).

    The rows of a key are dealt by ``by`` into ``SALTS`` parts, and ``few`` goes to each, so a frequent key is spread.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    names = {c: f"__few_{c}" for c in on}
    right = few.withColumnsRenamed(names).withColumn("__salt_few", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    same = F.col("__salt") == F.col("__salt_few")
    for c, renamed in names.items():
        same = same & F.col(c).eqNullSafe(F.col(renamed))
    return left.join(right, same).drop("__salt", "__salt_few", *names.values())
