"""Counting ad hoc patterns from stored postings, without the series.

For each dimension and pair of successive codes the postings hold where the pair starts, by blocks of rows: a row
for each (dimension, transition, block) with the ascending offsets in the block, which Parquet stores as deltas.  A
frequent pair has as many rows as blocks, so none grows with the series.  A pattern of length l is the
intersection of the postings of its l - 1 transitions in each of its dimensions, each shifted back by its
place; shifts cross at most one border of a block, and blocks are intersected where their rows meet.

A sequence of length 1 has no transition and is refused; its count is that of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.operators.order import CHUNK_ROWS, in_chunks

#: Rows of the series in a block.
BLOCK_ROWS = 1 << 16


def postings(series: DataFrame, dimensions: Sequence[str], chunk_rows: int | None = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """dimension, transition (``a-b``), block, n and offsets (ascending, from the block's first row)."""

    def add(order: WindowSpec) -> dict:
        pairs = {f"__{d}": F.concat_ws("-", F.col(d), F.lead(d, 1).over(order)) for d in dimensions}
        return pairs | {"__next": F.lead("idx", 1).over(order)}

    rows = in_chunks(series, 1, add, chunk_rows).where("__next IS NOT NULL")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"__{d}").alias("transition")) for d in dimensions])).alias("x")
    block = F.floor(F.col("idx") / block_rows).cast("long")
    rows = rows.select(each, block.alias("block"), (F.col("idx") - block * block_rows).cast("int").alias("offset")).select("x.*", "block", "offset")
    found = rows.groupBy("dimension", "transition", "block").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return found.select("dimension", "transition", "block", F.size("offsets").alias("n"), "offsets")


def write_postings(series: DataFrame, path: str, dimensions: Sequence[str], chunk_rows: int | None = CHUNK_ROWS) -> None:
    """Postings by dimension, sorted by transition, so that a lookup reads the row groups of its transitions only."""
    rows = postings(series, dimensions, chunk_rows)
    rows = rows.repartitionByRange("dimension", "transition", "block").sortWithinPartitions("dimension", "transition", "block")
    rows.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").partitionBy("dimension").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _terms(pattern: Mapping[str, Sequence[int | str]]) -> list[tuple[str, str, int]]:
    lengths = {len(codes) for codes in pattern.values()}
    if len(lengths) != 1 or lengths == {1} or lengths == {0}:
        raise ValueError("a pattern has a sequence of two codes or more for each of its dimensions, all of one length")
    return [(d, f"{a}-{b}", k) for d, codes in pattern.items() for k, (a, b) in enumerate(zip(codes, codes[1:]))]


def positions(index: DataFrame, patterns: Sequence[Mapping[str, Sequence[int | str]]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pattern (its place), block and offsets: where each of these patterns starts.  They must be few: a lookup
    of many is a mining run."""
    wanted = [(p, d, t, k) for p, pattern in enumerate(patterns) for d, t, k in _terms(pattern)]
    sizes = [len(_terms(pattern)) for pattern in patterns]
    spark = index.sparkSession
    terms = spark.createDataFrame([(p, d, t, k, n) for n, (p, d, t, k) in enumerate(wanted)], "pattern int, dimension string, transition string, place int, term int")
    used = reduce(lambda a, b: a | b, [(F.col("dimension") == d) & (F.col("transition") == t) for _, d, t, _ in wanted])  # reaches the scan
    rows = index.where(used).join(F.broadcast(terms), ["dimension", "transition"])
    shifted = F.transform("offsets", lambda x: x - F.col("place"))
    own = F.struct(F.col("block"), F.filter(shifted, lambda x: x >= 0).alias("starts"))
    before = F.struct((F.col("block") - 1).alias("block"), F.transform(F.filter(shifted, lambda x: x < 0), lambda x: x + block_rows).alias("starts"))
    parts = rows.select("pattern", "term", F.explode(F.array(own, before)).alias("x")).where(F.size("x.starts") > 0)
    # a block meets once for each pattern: at most two rows of each of the pattern's terms
    whole = parts.groupBy("pattern", "x.block", "term").agg(F.flatten(F.collect_list("x.starts")).alias("starts"))
    met = whole.groupBy("pattern", "block").agg(F.collect_list("starts").alias("terms"))
    asked = F.get(F.array(*[F.lit(n) for n in sizes]), F.col("pattern"))
    met = met.where(F.size("terms") == asked)
    both = F.aggregate(F.slice("terms", 2, len(wanted)), F.get("terms", 0), F.array_intersect)
    return met.select("pattern", "block", F.array_sort(both).alias("offsets")).where(F.size("offsets") > 0)


def lookup(index: DataFrame, patterns: Sequence[Mapping[str, Sequence[int | str]]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pattern (its place), cnt: how often each of these patterns occurs, 0 included."""
    found = positions(index, patterns, block_rows).groupBy("pattern").agg(F.sum(F.size("offsets").cast("long")).alias("cnt"))
    every = index.sparkSession.range(len(patterns)).select(F.col("id").cast("int").alias("pattern"))
    return every.join(found, "pattern", "left").select("pattern", F.coalesce("cnt", F.lit(0)).alias("cnt"))
