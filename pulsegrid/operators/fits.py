"""Power-law fits and their scores.

A fit of ``a * x**b * y**c ...`` starts from the linear fit of the logarithms and is refined by
Levenberg-Marquardt.  Each step sums the normal equations over all rows as one aggregate, for all groups at
once, and solves the small systems on the driver, which sees one row for each group.  The rows, logarithms taken,
are written once to the shared folder, so a step scans a few columns however the rows came about.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.operators.tables import materialise, release


def scores(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, r2 (squared correlation), its p_value, rmse and mae of the rows that have both values, for each group."""
    a, p = F.col(actual), F.col(predicted)
    rows = df.where(a.isNotNull() & p.isNotNull())
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.corr(a, p) * F.corr(a, p)).alias("r2"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
    )

    return found.withColumn("p_value", p_value(F.col("r2"), F.col("n")))


#: Coefficients of the expansion of ln(Gamma(z + 1/2) / Gamma(z)) - ln(z) / 2 in odd powers of 1 / z.
_HALF_STEP = ((1, -1 / 8), (3, 1 / 192), (5, -1 / 640), (7, 17 / 14336), (9, -31 / 18432))
#: Arguments are raised by this many before the expansion.
_RAISED = 12


def _log_gamma_ratio(z: Column) -> Column:
    """ln(Gamma(z + 1/2) / Gamma(z)) for z > 0."""
    high = z + F.lit(float(_RAISED))
    out = F.log(high) / 2
    for power, c in _HALF_STEP:
        out = out + F.lit(c) / F.pow(high, F.lit(float(power)))
    for k in range(_RAISED):
        out = out + F.log((z + float(k)) / (z + (k + 0.5)))
    return out


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function at x below (a + 1) / (a + b + 2), by Lentz's method."""
    tiny = F.lit(1e-300)

    def away(c: Column) -> Column:
        return F.when(F.abs(c) < tiny, tiny).otherwise(c)

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1 = 1 / away(1 + even * state["d"])
        c1 = away(1 + even / state["c"])
        d2 = 1 / away(1 + odd * d1)
        c2 = away(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (state["h"] * d1 * c1 * d2 * c2).alias("h"))

    d0 = 1 / away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    terms = F.transform(F.sequence(F.lit(1), (60 + 4 * F.sqrt(F.greatest(a, b))).cast("int")), lambda m: m.cast("double"))
    return F.aggregate(terms, start, step, lambda s: s["h"])


def p_value(r2: Column, n: Column) -> Column:
    """Two-sided p of a squared correlation under Student's t with n - 2 degrees of freedom; NaN without any.

    It is the regularised incomplete beta function at 1 - r2 with (n - 2) / 2 and 1/2, or what that leaves of 1 for
    the other end, whichever converges: some root of n steps.  Null for a null correlation.
    """
    free = F.greatest(n - 2, F.lit(1)).cast("double") / 2
    inside = F.least(F.greatest(r2, F.lit(1e-300)), F.lit(1 - 1e-16))
    x, half = 1 - inside, F.lit(0.5)
    # a half of ln(r2), free of ln(1 - r2), and 1 / B(free, 1/2)
    front = F.exp(free * F.log(x) + F.log(inside) / 2 + _log_gamma_ratio(free) - F.lit(math.log(math.pi) / 2))
    low = front * _beta_fraction(free, half, x) / free
    high = 1 - front * _beta_fraction(half, free, inside) / half
    found = F.when(x < (free + 1) / (free + 2.5), low).otherwise(high)
    return F.when(n <= 2, F.lit(float("nan"))).when(r2 >= 1, F.lit(0.0)).when(r2.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), found)))


#: Groups that are fitted together at most.
MOST_GROUPS = 20_000


def _normal_equations(rows: DataFrame, keys: Sequence[str], gradient: list[Column], residual: Column) -> DataFrame:
    k = len(gradient)
    sums = [F.sum(gradient[i] * gradient[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(gradient[i] * residual).alias(f"g{i}") for i in range(k)]
    return rows.groupBy(*keys).agg(*sums, F.sum(residual * residual).alias("loss"), F.count("*").alias("n"))


def _system(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
    return h, np.array([row[f"g{i}"] for i in range(k)])


def fit_power_law(
    df: DataFrame, target: str, factors: Sequence[str], keys: Sequence[str] = (), rounds: int = 25, tolerance: float = 1e-10
) -> DataFrame:
    """One row for each group: keys, a, b, c ... (``a`` and the exponents), n, rmse.

    Rows with a value that is not positive cannot be in a power law and are left out.  The least squares are
    in the target itself; parameters are ln(a) and the exponents, with centred logarithms, so that steps are
    well scaled whatever the size of ``a``.  ``keys`` must name few groups, ``MOST_GROUPS`` at most: their sums come to
    the driver and their parameters are broadcast.  More are refused.
    """
    good = F.col(target) > 0
    for f in factors:
        good = good & (F.col(f) > 0)
    logs = [F.log(F.col(f)).alias(f"x{i}") for i, f in enumerate(factors)]
    rows = materialise(df.where(good).select(*keys, F.col(target).cast("double").alias("y"), *logs), "fit")
    try:
        return _fitted(rows, keys, len(factors) + 1, rounds, tolerance)
    finally:
        release(rows)


def _fitted(rows: DataFrame, keys: Sequence[str], k: int, rounds: int, tolerance: float) -> DataFrame:
    """The fits of a table of rows: keys, y, and the logarithms x0, x1 ... of its k - 1 factors."""
    spark = rows.sparkSession
    if keys and rows.select(*keys).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    centre = rows.groupBy(*keys).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k - 1)]).collect()
    means = {tuple(r[c] for c in keys): [r[f"m{i}"] for i in range(k - 1)] for r in centre}
    base = list(rows.select(*keys).schema.fields)

    def joined(params: dict[tuple, np.ndarray]) -> DataFrame:
        names = [f"m{i}" for i in range(k - 1)] + [f"b{i}" for i in range(k)]
        data = [(*key, *map(float, means[key]), *map(float, p)) for key, p in params.items()]
        if not keys:
            return rows.withColumns(dict(zip(names, [F.lit(v) for v in data[0]])))
        schema = StructType(list(base))
        for n in names:
            schema = schema.add(n, "double")
        return rows.join(F.broadcast(spark.createDataFrame(data, schema)), list(keys))  # a row for each group

    def solve(params: dict[tuple, np.ndarray], linear: bool) -> dict[tuple, tuple]:
        at = joined(params)
        centred = [F.lit(1.0), *[F.col(f"x{i}") - F.col(f"m{i}") for i in range(k - 1)]]
        raw = F.lit(0.0)
        for i in range(k):
            raw = raw + F.col(f"b{i}") * centred[i]
        if linear:
            gradient, residual = centred, F.log("y") - raw
        else:
            fitted = F.exp(raw)
            gradient, residual = [fitted * c for c in centred], F.col("y") - fitted
        out = _normal_equations(at, keys, gradient, residual).collect()
        return {tuple(r[c] for c in keys): (*_system(r, k), r["loss"], r["n"]) for r in out}

    params = {key: np.zeros(k) for key in means if means[key] and means[key][0] is not None}
    if not params:
        return spark.createDataFrame([], _fit_schema(base, k))
    for key, (h, g, _, _) in solve(params, True).items():
        params[key] = np.linalg.lstsq(h, g, rcond=None)[0]
    damping = dict.fromkeys(params, 1e-3)
    state = solve(params, False)
    for _ in range(rounds):
        tried = {}
        for key, (h, g, _, _) in state.items():
            step = np.linalg.lstsq(h + damping[key] * np.diag(np.diag(h)), g, rcond=None)[0]
            tried[key] = params[key] + np.clip(step, -5, 5)
        new = solve(tried, False)
        moved = 0.0
        for key in params:
            if new[key][2] <= state[key][2]:
                moved = max(moved, (state[key][2] - new[key][2]) / max(state[key][2], 1e-300))
                params[key], state[key], damping[key] = tried[key], new[key], damping[key] / 10
            else:  # no step down is worse: where it is by no more than rounding, none is left
                stalled = new[key][2] - state[key][2] <= tolerance * state[key][2]
                moved, damping[key] = max(moved, 0.0 if stalled else 1.0), damping[key] * 10
        if moved < tolerance:
            break
    out = []
    for key, p in params.items():
        scale = math.exp(p[0] - sum(b * m for b, m in zip(p[1:], means[key])))
        out.append((*key, scale, *map(float, p[1:]), int(state[key][3]), math.sqrt(state[key][2] / state[key][3])))
    return spark.createDataFrame(out, _fit_schema(base, k))


def _fit_schema(keys: list, k: int):
    schema = StructType(list(keys))
    for name in "abcdefgh"[:k]:
        schema = schema.add(name, "double")
    return schema.add("n", "long").add("rmse", "double")


def min_merge(base: DataFrame, predictions: DataFrame, name: str = "predicted") -> DataFrame:
    """``base`` (idx, predicted) where a pattern's prediction for the row is lower: that one."""
    least = predictions.groupBy("idx").agg(F.min(name).alias("__least"))
    return base.join(least, "idx", "left").withColumn(name, F.least(name, "__least")).drop("__least")


def recombine(*parts: DataFrame) -> DataFrame:
    """Disjoint predictions (idx, predicted) as one."""
    out = parts[0].select("idx", "predicted")
    for p in parts[1:]:
        out = out.unionByName(p.select("idx", "predicted"))
    return out
