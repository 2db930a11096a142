"""Co-occurrence of event sequences with flagged windows.

A pattern is a sequence of codes for each of some dimensions, at the same rows.  Its occurrences are counted
at every offset of the whole series; an occurrence joins a flagged window that starts 0..lag rows after it.
That needs no join: the number of flagged starts in the next ``lag`` rows is a window sum.  Sequences are packed
into longs (``packed``), all subsets of dimensions are counted in one pass, and from ``LEVELWISE`` dimensions on they
are counted level by level, expanding only rows whose patterns can still count (``levels``).  Several rules and
lags are counted together: they share the series, its sequences and the count of each pattern.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.functions.rules import Frame, WindowRule
from pulsegrid.operators import levels
from pulsegrid.operators.order import CHUNK_ROWS, SALTS, in_chunks, join_few
from pulsegrid.operators.packed import Codec, codecs, texts
from pulsegrid.operators.tables import materialise
from pulsegrid.operators.windows import RUN, candidate_ahead, unbroken

LEVELWISE = 5


@dataclass(frozen=True)
class MiningConfig:
    """What to mine.  ``within_run`` counts only occurrences that stay in one run (the default counts all)."""

    rule: WindowRule
    dimensions: Sequence[str]
    lag: int = 1
    k_threshold: float = 1.0
    min_support: float = 0.0
    lengths: Sequence[int] = (3,)
    run: Sequence[str] = RUN
    within_run: bool = False
    chunk_rows: int | None = CHUNK_ROWS
    strategy: str = field(default="auto")

    def __post_init__(self) -> None:
        if not self.dimensions:
            raise ValueError("no dimension")
        if self.lag < 0 or any(n < 1 for n in self.lengths):
            raise ValueError("lag is 0 or more, a pattern length 1 or more")
        if not 0 <= self.min_support <= 1:
            raise ValueError("min_support is a share")
        if self.strategy not in ("auto", "cube", "levelwise"):
            raise ValueError(f"no strategy {self.strategy!r}")


@dataclass(frozen=True)
class _Sequences:
    """The rows of a series with the sequences that start there: s<n>_<dimension>_<k>, whole<n>, and for each variant
    v (a rule and a lag) is_anom<rule>, n_join<v> (flagged starts within the lag) and cand<v> (whether a flagged window
    of its run is near)."""

    rows: DataFrame
    codecs: list[Codec]
    rule_of: list[int]


def _sequences(series: DataFrame, configs: Sequence[MiningConfig]) -> _Sequences:
    """In one pass over the chunks of ``series``, for all lengths, rules and lags."""
    base = configs[0]
    rules = list(dict.fromkeys(c.rule for c in configs))
    lengths = sorted({n for c in configs for n in c.lengths})
    coded = codecs(series, base.dimensions)

    def add(order: WindowSpec) -> list[dict[str, Column]]:
        first = {f"is_anom{k}": unbroken(order, r.length, base.run) & r(Frame(order, r.length)) for k, r in enumerate(rules)}
        first |= {f"__digit_{c.name}": c.digit() for c in coded}
        out: dict[str, Column] = {}
        for n in lengths:
            for c in coded:
                out |= c.pack(order, n, f"__digit_{c.name}")
            whole = F.lead("idx", n - 1).over(order).isNotNull()
            out[f"whole{n}"] = whole & unbroken(order, n, base.run) if base.within_run else whole
        for v, c in enumerate(configs):
            flagged = f"is_anom{rules.index(c.rule)}"
            out[f"n_join{v}"] = F.sum(F.col(flagged).cast("long")).over(order.rowsBetween(0, c.lag))
            out[f"cand{v}"] = candidate_ahead(order, c.lag, base.run, flagged)
        return [first, out]

    ahead = max(max(lengths) - 1, *[c.rule.length - 1 + c.lag for c in configs])
    rows = in_chunks(series, ahead, add, base.chunk_rows, keep_chunk=True)
    names = [x for n in lengths for c in coded for x in c.columns(n)]
    flags = [f"is_anom{k}" for k in range(len(rules))]
    of_variant = [f"{x}{v}" for v in range(len(configs)) for x in ("n_join", "cand")]
    kept = rows.select("__chunk", "idx", *names, *[f"whole{n}" for n in lengths], *of_variant, *flags)
    return _Sequences(kept, coded, [rules.index(c.rule) for c in configs])


def occurrences(series: DataFrame, config: MiningConfig, lengths: Sequence[int] | None = None) -> DataFrame:
    """A row for each offset and length (of ``lengths``) that holds a whole sequence: idx, pattern_len, the text
    p_<dimension> of each dimension, n_join (flagged starts within the lag) and cand (whether a flagged window of its
    run is near)."""
    lengths = list(lengths or config.lengths)
    found = _sequences(series, [replace(config, lengths=lengths)])
    made = [f"if(whole{n}, named_struct('pattern_len', {n}, {', '.join(f"'p_{c.name}', {c.text(n)}" for c in found.codecs)}), NULL)" for n in lengths]
    rows = found.rows.select("idx", F.expr(f"explode(array({', '.join(made)})) AS x"), "n_join0", "cand0").where("x IS NOT NULL")
    return rows.select("idx", "x.*", F.col("n_join0").alias("n_join"), F.col("cand0").alias("cand"))


def _least(config: MiningConfig, n: int) -> int:
    """Occurrences of a pattern with enough support; the exact share is tested again below."""
    return max(1, math.ceil(config.min_support * n * (1 - 1e-9)))


def _scored(found: DataFrame, length: int, config: MiningConfig, v: int, n: int, w: int) -> DataFrame:
    """The patterns of variant ``v`` with their measures."""
    names = [f"p_{d}" for d in config.dimensions]
    count, join = F.col("cnt").cast("double"), F.col(f"join{v}")
    dims = reduce(lambda a, b: a + b, [F.col(p).isNotNull().cast("int") for p in names])
    k_value = F.when(F.lit(w > 0), F.lit(float(n)) * join.cast("double") / (count * F.lit(max(float(w), 1.0))))
    scored = found.where(F.col(f"cand{v}")).select(
        *names,
        F.lit(length).alias("pattern_len"),
        dims.alias("n_dims"),
        "cnt",
        join.alias("join_cnt"),
        F.col(f"distinct{v}").alias("distinct_join"),
        (count / F.lit(float(max(n, 1)))).alias("support"),
        k_value.alias("k_value"),
        (F.col(f"distinct{v}") / count).alias("confidence"),
    )
    return scored.where(F.col("support") >= config.min_support)


def candidates_of(series: DataFrame, configs: Sequence[MiningConfig], bounded: bool = False, top: int | None = None,
                  report: list[levels.LevelReport] | None = None) -> DataFrame:
    """The candidates of several configs that differ in rule, lag and thresholds only, with the column ``variant``.

    With ``bounded``, patterns that cannot pass their config's threshold of cross-K may be missing; with ``top``, those
    that cannot be among that many of highest cross-K, either.  ``report`` gets what each level counted.

    The series is read, ordered and cut once; its sequences are held (memory, then disk) while the patterns are counted,
    which happens here.  The patterns are written to the shared folder, so nothing stays cached.
    """
    base = configs[0]
    if any(replace(c, rule=base.rule, lag=base.lag, k_threshold=base.k_threshold, min_support=base.min_support) != base for c in configs):
        raise ValueError("configs counted together differ in rule, lag and thresholds only")
    seen = _sequences(series, configs)
    rows = seen.rows.persist(StorageLevel.MEMORY_AND_DISK)
    flags = [c for c in rows.columns if c.startswith("is_anom")]
    total = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in flags]).first()
    n, w = total["n"], [total[f"is_anom{r}"] or 0 for r in seen.rule_of]
    rows_only = rows.drop(*flags)
    by_level = base.strategy == "levelwise" or (base.strategy == "auto" and len(base.dimensions) >= LEVELWISE)
    least = [_least(c, n) for c in configs]
    counters: list[levels.LevelCounter] = []
    found: list[tuple[int, DataFrame]] = []
    if not by_level or not n:
        for length in base.lengths:
            found.append((length, levels.count_all(rows_only.where(f"whole{length}"), seen.codecs, length, len(configs), min(least))))
    else:
        variants = [levels.Variant(w[v], least[v], c.k_threshold if bounded else None) for v, c in enumerate(configs)]
        best: list[DataFrame] = []

        def tighten(level: DataFrame) -> list[levels.Variant]:
            """The threshold of cross-K rises to the k-th best so far."""
            none = level.withColumns({f"p_{d}": F.lit(None).cast("string") for d in base.dimensions})
            best.append(_scored(none, 0, base, 0, n, w[0]).where(F.col("k_value") > F.lit(base.k_threshold)).select("k_value"))
            values = [r[0] for r in reduce(DataFrame.unionByName, best).orderBy(F.col("k_value").desc()).limit(top).collect()]
            return [replace(variants[0], threshold=values[-1], strict=False)] if len(values) == top else variants

        # with within_run a whole long sequence need not start with a whole short one
        for group in [[x] for x in base.lengths] if base.within_run else [list(base.lengths)]:
            counter = levels.LevelCounter(rows_only, seen.codecs, n, variants, group, tighten if top else None, report)
            found += counter.run()
            counters.append(counter)
    out = []
    for length in dict.fromkeys(length for length, _ in found):  # levels meet as longs and become texts together
        words = reduce(DataFrame.unionByName, [f for n_, f in found if n_ == length])
        own = {x for c in seen.codecs for x in c.columns(length)}
        shown = words.select(*texts(seen.codecs, length), *[c for c in words.columns if c not in own])
        out += [_scored(shown, length, c, v, n, w[v]).withColumn("variant", F.lit(v)) for v, c in enumerate(configs)]
    counted = materialise(reduce(DataFrame.unionByName, out), "patterns")
    for counter in counters:
        counter.close()
    rows.unpersist()
    return counted


def candidates(series: DataFrame, config: MiningConfig) -> DataFrame:
    """Every pattern with enough support that starts near a flagged window, with its measures.

    Columns: a p_<dimension> for each dimension (null: not part of the pattern), pattern_len, n_dims, cnt,
    join_cnt, distinct_join, support, k_value, confidence.
    """
    return candidates_of(series, [config]).drop("variant")


def filter_log(log: DataFrame, k_threshold: float = 1.0, min_support: float = 0.0) -> DataFrame:
    """block, k_value, n_starts of the patterns of an occurrence log (block, start_idx, k_value) with cross-K from the
    threshold on and enough starts, as a share of the log's lines (a start each, and a cross-K for each block)."""
    blocks = log.groupBy("block").agg(F.max("k_value").alias("k_value"), F.count("*").alias("n_starts"))
    lines = blocks.agg((F.sum("n_starts") + F.count("*")).alias("lines")).select("lines")  # one row
    kept = blocks.join(F.broadcast(lines)).where((F.col("k_value") >= k_threshold) & (F.col("n_starts") >= min_support * F.col("lines")))
    return kept.select("block", "k_value", "n_starts")


def mine(series: DataFrame, config: MiningConfig) -> DataFrame:
    """The patterns whose temporal cross-K lies above the threshold."""
    return candidates_of(series, [config], bounded=True).drop("variant").where(F.col("k_value") > F.lit(config.k_threshold))


def mine_all(series: DataFrame, configs: Sequence[MiningConfig]) -> DataFrame:
    """The patterns of several configs, counted together; ``variant`` is the config's place."""
    passes = F.lit(False)
    for v, c in enumerate(configs):
        passes = F.when(F.col("variant") == v, F.col("k_value") > F.lit(c.k_threshold)).otherwise(passes)
    return candidates_of(series, configs, bounded=True).where(passes)


def mine_top(series: DataFrame, config: MiningConfig, k: int = 100, report: list[levels.LevelReport] | None = None) -> DataFrame:
    """The k patterns of highest cross-K, as ``top_k(mine(...), k)``.

    Levels are counted with a threshold that rises to the k-th best cross-K so far, so patterns, and sets of dimensions,
    none of whose extensions can reach it are not extended.
    """
    config = replace(config, strategy="levelwise")
    found = candidates_of(series, [config], bounded=True, top=k, report=report).drop("variant")
    return top_k(found.where(F.col("k_value") > F.lit(config.k_threshold)), k)


def level_report(series: DataFrame, config: MiningConfig) -> DataFrame:
    """What each level of a level-wise search counted: pattern_len, n_dims, n_sets, n_expanded (keys made for rows),
    n_frequent (patterns with enough support), n_extended (those that the next level builds on)."""
    report: list[levels.LevelReport] = []
    candidates_of(series, [replace(config, strategy="levelwise")], bounded=True, report=report)
    rows = [(r.length, r.size, r.sets, r.expanded, r.frequent, r.extended) for r in report]
    return series.sparkSession.createDataFrame(rows, "pattern_len int, n_dims int, n_sets long, n_expanded long, n_frequent long, n_extended long")


def names_of(patterns: DataFrame) -> list[str]:
    return [c for c in patterns.columns if c.startswith("p_")]


def _ordered(patterns: DataFrame, *first: str) -> list[Column]:
    ties = [*(F.col(c).desc() for c in first), F.col("pattern_len")]
    return [*ties, *[F.col(c).asc_nulls_first() for c in names_of(patterns)]]


def top_k(patterns: DataFrame, k: int = 100) -> DataFrame:
    """The k patterns of highest cross-K; ties by join count, then by the pattern itself."""
    return patterns.orderBy(*_ordered(patterns, "k_value", "join_cnt")).limit(k)


def ranked_by_k(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(*_ordered(patterns, "k_value", "join_cnt"))


def ranked_by_join(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(*_ordered(patterns, "join_cnt", "k_value"))


def k_statistics(found: DataFrame) -> DataFrame:
    """Mean and population deviation of cross-K over all candidates, by pattern length."""
    return found.groupBy("pattern_len").agg(
        F.count("*").alias("n_candidates"), F.avg("k_value").alias("avg_k"), F.stddev_pop("k_value").alias("std_k")
    )


def size_metrics(series: DataFrame, config: MiningConfig) -> DataFrame:
    """How many candidates and kept patterns there are, by number of dimensions."""
    found = candidates(series, config)
    kept = (F.col("k_value") > F.lit(config.k_threshold)).cast("long")
    return found.groupBy("pattern_len", "n_dims").agg(F.count("*").alias("n_candidates"), F.sum(kept).alias("n_kept"))


def pattern_text(patterns: DataFrame) -> Column:
    """``name:<tab>codes`` of each dimension of the pattern, one a line."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c[2:] + ":\t"), F.col(c))) for c in names_of(patterns)]
    return F.concat_ws("\n", *parts)


def _six_digits(x: Column) -> Column:
    """``x`` rounded as the SQL does it: the double x * 1e6 to a whole number, halves away from zero.

    Formatting alone rounds the shortest decimal text of x, which is another number where x * 1e6 falls beside a half.
    """
    return F.round(x * F.lit(1e6)) / F.lit(1e6)


def report(patterns: DataFrame, n_rows: int, n_windows: int) -> DataFrame:
    """``patterns`` with the text of a report block."""
    rows = F.lit(float(max(n_rows, 1)))
    support, joint = _six_digits(F.col("support")), _six_digits(F.col("join_cnt") / rows)
    windows = _six_digits(F.lit(float(n_windows)) / rows)
    lines = [
        pattern_text(patterns),
        F.format_string("count %d, support %.6f", "cnt", support),
        F.format_string("windows %d, support %.6f", F.lit(n_windows), windows),
        F.format_string("joint %d (%d distinct), support %.6f", "join_cnt", "distinct_join", joint),
        F.format_string("cross-K %.6f, confidence %.6f", _six_digits(F.col("k_value")), _six_digits(F.col("confidence"))),
    ]
    return patterns.withColumn("report", F.concat_ws("\n", *lines))


def occurrence_log(series: DataFrame, config: MiningConfig, kept: DataFrame | None = None) -> DataFrame:
    """A row for each joined occurrence of each kept pattern: the pattern, start_idx, k_value.

    A pattern without a dimension matches any text of it.  So each occurrence gets a key for every set of
    dimensions that a kept pattern has (no more than 2 ** dimensions), made of the set and its texts, and one
    equi-join on that key finds its patterns.
    """
    kept = materialise(mine(series, config) if kept is None else kept, "kept")
    names = names_of(kept)
    shapes = kept.select(*[F.col(n).isNotNull().alias(n) for n in names]).distinct().collect()
    sets = sorted([n for n in names if r[n]] for r in shapes)
    columns = [*names, "pattern_len", "start_idx", "k_value"]
    if not sets:
        return kept.withColumn("start_idx", F.lit(0).cast("long")).select(*columns).limit(0)

    def key(k: int) -> Column:
        return F.concat_ws("\x01", F.lit(str(k)), *[F.col(n) for n in sets[k]])

    own = F.lit(None).cast("string")
    for k, on in enumerate(sets):
        same = reduce(lambda a, b: a & b, [F.col(n).isNotNull() if n in on else F.col(n).isNull() for n in names])
        own = F.when(same, key(k)).otherwise(own)
    keyed = kept.withColumn("__key", own)
    rows = occurrences(series, config).where("n_join > 0")
    keys = F.explode(F.array(*[key(k) for k in range(len(sets))]))
    rows = rows.select(F.col("idx").alias("start_idx"), "pattern_len", keys.alias("__key"))
    return join_few(rows, keyed, ["pattern_len", "__key"], by="start_idx").select(*columns)


#: Rows of the series that a bin of ``window_pairs`` spans at most.
BIN_ROWS = 4_096


def window_pairs(log: DataFrame, flagged: DataFrame, lag: int) -> DataFrame:
    """``log`` (start_idx and more) with window_start: a row for each flagged window (start_idx) 0..lag rows ahead.

    An interval join by bins of rows: an occurrence goes to every bin that its lag reaches, two for bins as wide as the
    lag, and meets the windows there.  A bin holds no more windows than it spans rows; the occurrences of a bin are dealt
    by their other columns too, so many patterns at one place are no hot key.  At most lag + 1 rows for each occurrence.
    """
    width = min(lag + 1, BIN_ROWS)
    others = [F.col(c).cast("string") for c in log.columns if c != "start_idx"]
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)) if others else F.lit(0).cast("long")
    first, last = F.floor(F.col("start_idx") / width), F.floor((F.col("start_idx") + lag) / width)
    left = log.withColumn("__salt", salt).withColumn("__bin", F.explode(F.sequence(first, last)))
    right = flagged.select(F.col("start_idx").alias("window_start"), F.floor(F.col("start_idx") / width).alias("__bin"))
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    near = (F.col("window_start") >= F.col("start_idx")) & (F.col("window_start") <= F.col("start_idx") + lag)
    return left.join(right, ["__bin", "__salt"]).where(near).drop("__bin", "__salt")


def transitions(series: DataFrame, dimensions: Iterable[str], chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """For each dimension and pair of successive codes ``a-b``, how often it occurs and where first and last."""
    dims = list(dimensions)

    def add(order: WindowSpec) -> dict[str, Column]:
        return {f"__{d}": F.concat_ws("-", F.col(d), F.lead(d, 1).over(order)) for d in dims} | {
            "__next": F.lead("idx", 1).over(order)
        }

    rows = in_chunks(series, 1, add, chunk_rows).where("__next IS NOT NULL")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"__{d}").alias("transition")) for d in dims]))
    return rows.select("idx", pairs.alias("x")).groupBy("x.dimension", "x.transition").agg(
        F.count("*").alias("cnt"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


def transition_index(series: DataFrame, dimension: str, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """A row for each start of each pair of successive codes: transition, idx."""
    rows = in_chunks(
        series, 1, lambda o: {"__next": F.lead("idx", 1).over(o), "transition": F.concat_ws("-", F.col(dimension), F.lead(dimension, 1).over(o))}, chunk_rows
    )
    return rows.where("__next IS NOT NULL").select("transition", "idx")


def with_lag(config: MiningConfig, lag: int) -> MiningConfig:
    return replace(config, lag=lag)
