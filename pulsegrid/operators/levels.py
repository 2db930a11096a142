"""Counting sequences over sets of dimensions, level by level, expanding only rows that can still count.

Every row of a series starts one sequence for each set of dimensions.  A pattern is extended only if it has
enough support, starts near a flagged window and, where a threshold of cross-K is known, can still pass it: with
n rows, w flagged windows and at least ``least`` occurrences asked for,

    cross-K of any extension <= n * join count of the pattern / (least * w),

since an extension joins no more often than what it extends and counts ``least`` at least.  All three can only
get harder with more dimensions or longer sequences.  After each level a row gets a mask of its sets whose patterns go
on, from a hash table of these patterns (broadcast within a counted bound, else joined by shuffle); the next level
makes a key only for sets all of whose subsets of one less are in the mask.  For a longer length it also
asks that the set's shorter sequence at the same row goes on, and that no single dimension's shorter sequence at the end
of the longer one is too rare.

Rows stay dealt by chunk of the series throughout, so that masks are made without a shuffle; keys are packed longs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.packed import Codec, Layout
from pulsegrid.operators.tables import materialise, release

#: Patterns of a level up to this many are broadcast, after a count.
BROADCAST_PATTERNS = 200_000
_ROW = ["__chunk", "idx"]


@dataclass(frozen=True)
class Variant:
    """One pair of rule and lag: its number of flagged windows, the least count and the threshold of cross-K.

    ``threshold`` None extends whatever has support; otherwise patterns whose extensions cannot reach it (``strict``:
    cannot exceed it) are not extended.
    """

    windows: int
    least: int
    threshold: float | None = None
    strict: bool = True

    def can_pass(self, n: int, join: Column) -> Column:
        if self.threshold is None:
            return F.lit(True)
        most = n * join.cast("double") / float(max(1, self.least) * max(1, self.windows)) * (1 + 1e-9)
        return most > self.threshold if self.strict else most >= self.threshold


@dataclass
class LevelReport:
    length: int
    size: int
    #: sets of dimensions that were counted, keys made for rows, patterns with enough support, those extended
    sets: int
    expanded: int | None
    frequent: int
    extended: int


def measures(variants: int) -> list[Column]:
    out = [F.count("*").alias("cnt")]
    for v in range(variants):
        joined = F.sum((F.col(f"n_join{v}") > 0).cast("long"))
        out += [F.sum(f"n_join{v}").alias(f"join{v}"), joined.alias(f"distinct{v}"), F.max(f"cand{v}").alias(f"cand{v}")]
    return out


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _has(masks: Sequence[str], bits: Sequence[int]) -> str:
    """SQL for whether all these bits are set in a mask of several longs."""
    want: dict[int, int] = {}
    for b in bits:
        want[b // 62] = want.get(b // 62, 0) | 1 << b % 62
    return " AND ".join(f"(`{masks[w]}` & {m}L) = {m}L" for w, m in want.items())


def expand(rows: DataFrame, layout: Layout, conditions: Sequence[str | None], carry: Sequence[str], outer: bool = False) -> DataFrame:
    """A row for each row and set whose condition (SQL) holds: the set's key and the columns to carry.  With ``outer``
    rows may also come without a key."""
    keys = [layout.key(i) if c is None else f"if({c}, {layout.key(i)}, NULL)" for i, c in enumerate(conditions)]
    made = rows.select(*carry, F.expr(f"explode(array({', '.join(keys + ['NULL'] * outer)})) AS k0"))
    if not outer and any(c is not None for c in conditions):
        made = made.where("k0 IS NOT NULL")
    return made if len(layout.keys) == 1 else made.selectExpr(*carry, *[f"k0.{k} AS {k}" for k in layout.keys])


def count_all(rows: DataFrame, codecs: Sequence[Codec], length: int, variants: int, least: float) -> DataFrame:
    """All sets of dimensions at once: the longs and measures of the patterns with enough support near a flagged window."""
    names = [c.name for c in codecs]
    layout = Layout(codecs, length, [s for k in range(1, len(names) + 1) for s in combinations(names, k)])
    carry = [f"{c}{v}" for v in range(variants) for c in ("n_join", "cand")]
    counted = expand(rows, layout, [None] * len(layout.sets), carry).groupBy(*layout.keys).agg(*measures(variants))
    near = _any([F.col(f"cand{v}") for v in range(variants)])
    return counted.where(near & (F.col("cnt") >= least)).select(*layout.words(), *[c for c in counted.columns if c not in layout.keys])


class LevelCounter:
    """Counts the lengths of one series, ascending; ``tighten`` may raise thresholds after each level."""

    def __init__(self, rows: DataFrame, codecs: Sequence[Codec], n: int, variants: Sequence[Variant], lengths: Sequence[int],
                 tighten: Callable[[DataFrame], Sequence[Variant]] | None = None, report: list[LevelReport] | None = None):
        self.rows, self.codecs, self.n, self.variants, self.lengths = rows, list(codecs), n, list(variants), sorted(set(lengths))
        self.tighten, self.report = tighten, report
        self.held: list[DataFrame] = []
        self.written: list[DataFrame] = []
        self.found: list[tuple[int, DataFrame]] = []
        #: shorter length -> set -> (mask columns, bit); and the column of dimensions that are too rare
        self.shorter: dict[frozenset, tuple[list[str], int]] | None = None
        self.rare: tuple[str, int] | None = None

    def _keep(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def run(self) -> list[tuple[int, DataFrame]]:
        """(length, longs and measures of the patterns with enough support near a flagged window) of each level."""
        for length in self.lengths:
            self._length(length, more=length != self.lengths[-1])
        return self.found

    def close(self) -> None:
        for df in self.held:
            df.unpersist()
        for df in self.written:
            release(df)

    def _extends(self) -> Column:
        return _any([F.col(f"cand{v}") & (F.col("cnt") >= x.least) & x.can_pass(self.n, F.col(f"join{v}")) for v, x in enumerate(self.variants)])

    def _length(self, length: int, more: bool) -> None:
        names = [c.name for c in self.codecs]
        carry = [f"{c}{v}" for v in range(len(self.variants)) for c in ("n_join", "cand")]
        least = min(v.least for v in self.variants)
        rows, shorter, rare = self.rows, self.shorter, self.rare
        kept: dict[frozenset, tuple[list[str], int]] = {}
        sets = [frozenset([d]) for d in names if shorter is None or frozenset([d]) in shorter]
        masks: list[str] = []
        alive: dict[frozenset, int] = {}
        size = 1
        while sets:
            ordered = [tuple(d for d in names if d in s) for s in sets]
            layout = Layout(self.codecs, length, ordered)
            conditions = []
            for s in sets:
                asked = [f"whole{length}"] if size == 1 else [_has(masks, [alive[s - {d}] for d in s])]
                if shorter is not None:
                    bits = sum(1 << names.index(d) for d in s)
                    asked += [_has(shorter[s][0], [shorter[s][1]]), f"coalesce((`{rare[0]}` & {bits}L) = 0, true)"]
                conditions.append(" AND ".join(asked))
            keys = expand(rows, layout, conditions, carry)
            level = keys.groupBy(*layout.keys).agg(*measures(len(self.variants))).where(F.col("cnt") >= least)
            level = materialise(level.withColumns({"__on": self._extends(), "s": layout.number()}), "level")  # small; and it ends the plan
            self.written.append(level)
            expanded = keys.count() if self.report is not None else None
            stats = level.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("__on").cast("long")).alias("on")).collect()
            near = _any([F.col(f"cand{v}") for v in range(len(self.variants))])
            words = level.where(near).select(*layout.words(), *[c for c in level.columns if c not in [*layout.keys, "s", "__on"]])
            self.found.append((length, words))
            if self.report is not None:
                self.report.append(LevelReport(length, size, len(sets), expanded, sum(r["n"] for r in stats), sum(r["on"] for r in stats)))
            if self.tighten is not None:
                self.variants = list(self.tighten(words))
                level = level.withColumn("__on", self._extends())
                stats = level.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("__on").cast("long")).alias("on")).collect()
            live = {sets[r["s"]] for r in stats if r["on"]}
            alive = {s: k for k, s in enumerate(sets) if s in live}
            grown = {a | b for a, b in combinations(live, 2) if len(a | b) == size + 1}
            after = sorted((s for s in grown if all(s - {d} in live for d in s) and (shorter is None or s in shorter)), key=sorted)
            if not after and not more:
                break
            masks = [f"m{length}_{size}_{w}" for w in range(-(-len(sets) // 62))]
            kept |= {s: (masks, k) for s, k in alive.items()}
            first = size == 1 and more
            rows = self._masked(rows, level, layout, conditions, masks, sum(r["n"] for r in stats), more, f"rare{length}" if first else None)
            sets, size = after, size + 1
        if more:
            self.shorter = kept
        if more and kept:
            longer = self.lengths[self.lengths.index(length) + 1]
            at_end = F.lead(f"rare{length}", longer - length).over(Window.partitionBy("__chunk").orderBy("idx"))
            ended = rows.withColumn(f"end{length}", at_end)
            self.rows, self.rare = self._keep(ended), (f"end{length}", length)

    def _masked(self, rows: DataFrame, level: DataFrame, layout: Layout, conditions: Sequence[str], masks: list[str], patterns: int,
                everything: bool, rare: str | None) -> DataFrame:
        """``rows`` with the mask of the sets that go on; unless ``everything`` is asked for, only rows that have one."""
        columns = [c for c in rows.columns if c not in _ROW]
        keys = expand(rows, layout, conditions, rows.columns, outer=everything)
        known = (level if everything else level.where("__on")).select(*layout.keys, "s", "__on")
        keys = keys.join(F.broadcast(known) if patterns <= BROADCAST_PATTERNS else known, layout.keys, "left" if everything else "inner")
        out = [F.first(c).alias(c) for c in columns]
        for w, name in enumerate(masks):
            bit = F.when(F.col("__on") & (F.expr("s div 62") == w), F.expr("shiftleft(1L, cast(s % 62 as int))")).otherwise(F.lit(0).cast("long"))
            out.append(F.bit_or(bit).alias(name))
        if rare is not None:
            names = [c.name for c in self.codecs]
            bit = F.get(F.array(*[F.lit(1 << names.index(x[0])).cast("long") for x in layout.sets]), layout.number())
            out.append(F.bit_or(F.when(F.col("k0").isNotNull() & F.col("__on").isNull(), bit).otherwise(F.lit(0).cast("long"))).alias(rare))
        return self._keep(keys.groupBy(*_ROW).agg(*out))
