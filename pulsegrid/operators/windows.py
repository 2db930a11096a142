"""Fixed-length windows of a series and the rules that flag them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.functions.rules import Frame, WindowRule
from pulsegrid.operators.order import CHUNK_ROWS, in_chunks

#: Columns that tell one measurement run from another.
RUN = ("year", "month", "day", "pass")


def unbroken(order: WindowSpec, length: int, run: Sequence[str] = RUN) -> Column:
    """Whether both ends of the window are in one run and its iterations have no gap."""
    same = F.lead("iteration", length - 1).over(order) - F.col("iteration") + 1 == length
    for c in run:
        same = same & (F.lead(c, length - 1).over(order) == F.col(c))
    return F.coalesce(same, F.lit(False))


def flag(
    series: DataFrame, rule: WindowRule, name: str = "is_anom", run: Sequence[str] = RUN, chunk_rows: int | None = CHUNK_ROWS
) -> DataFrame:
    """``series`` with a boolean: whether a window that the rule calls bad starts at the row."""

    def add(order: WindowSpec) -> dict[str, Column]:
        return {name: unbroken(order, rule.length, run) & rule(Frame(order, rule.length))}

    return in_chunks(series, rule.length - 1, add, chunk_rows)


def listing(series: DataFrame, rule: WindowRule, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The flagged windows: first and last index and iteration, and the text ``<first,last>`` of the latter."""

    def add(order: WindowSpec) -> dict[str, Column]:
        good = unbroken(order, rule.length) & rule(Frame(order, rule.length))
        return {"__bad": good, "end_iteration": F.lead("iteration", rule.length - 1).over(order)}

    rows = in_chunks(series, rule.length - 1, add, chunk_rows).where("__bad")
    return rows.select(
        F.col("idx").alias("start_idx"),
        (F.col("idx") + rule.length - 1).alias("end_idx"),
        F.col("iteration").alias("start_iteration"),
        "end_iteration",
        F.format_string("<%d,%d>", "iteration", "end_iteration").alias("label"),
    )


def counts_by_length(series: DataFrame, rules: Iterable[WindowRule]) -> DataFrame:
    """How many windows each rule flags, by its length; one pass over the series for all of them."""
    rules = list(rules)
    ahead = max(r.length for r in rules) - 1

    def add(order: WindowSpec) -> dict[str, Column]:
        return {f"__{k}": unbroken(order, r.length) & r(Frame(order, r.length)) for k, r in enumerate(rules)}

    rows = in_chunks(series, ahead, add)
    pairs = F.explode(F.array(*[F.struct(F.lit(r.length).alias("length"), F.col(f"__{k}").cast("long").alias("bad")) for k, r in enumerate(rules)]))
    return rows.select(pairs.alias("x")).groupBy("x.length").agg(F.sum("x.bad").alias("n_windows"))


def candidate(lag: int, run: Sequence[str] = RUN, flagged: str = "is_anom") -> Column:
    """Whether a flagged window of the same run starts within ``lag`` iterations from the row on.

    Iterations must rise strictly inside a run.
    """
    near = Window.partitionBy(*run).orderBy("iteration").rangeBetween(0, lag)
    return F.max(F.col(flagged)).over(near)


def candidate_ahead(order: WindowSpec, lag: int, run: Sequence[str] = RUN, flagged: str = "is_anom") -> Column:
    """The same by the next ``lag`` rows of the whole order, so that it shares the order's shuffle and sort."""
    near = F.col(flagged)
    for k in range(1, lag + 1):
        same = F.lead("iteration", k).over(order) - F.col("iteration") <= lag
        for c in run:
            same = same & (F.lead(c, k).over(order) == F.col(c))
        near = near | F.coalesce(same & F.lead(flagged, k).over(order), F.lit(False))
    return near


def candidate_starts(series: DataFrame, rule: WindowRule, lag: int, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The rows from which a flagged window of their run starts within ``lag``: idx, iteration."""

    def add(order: WindowSpec) -> list[dict[str, Column]]:
        bad = unbroken(order, rule.length) & rule(Frame(order, rule.length))
        return [{"is_anom": bad}, {"__near": candidate_ahead(order, lag)}]

    return in_chunks(series, rule.length - 1 + lag, add, chunk_rows).where("__near").select("idx", "iteration")
