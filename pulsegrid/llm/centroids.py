"""Centroid clustering with Drake's adaptive bounds, in exact integers.

A vector keeps an upper bound on the distance to its own centroid, lower bounds on those to the next nearest few
and one remainder bound for all other centroids.  When centroids move, each bound is loosened by how far.  A
vector whose upper bound lies below all its lower bounds keeps its centroid unseen; otherwise the distances whose
order the bounds leave open are computed, and all of them if the remainder bound is open too.  How many bounds
are kept follows what the last round used.  Bounds are rounded outwards and compared strictly, and distances are
squared in integers, so the result is that of the plain algorithm, ties included.

Vectors lie in a table with their bounds, written once a round; only the centroids, ``k`` rows, pass through the
driver and to the tasks.  The sums of clusters are brought up to date by the vectors that changed cluster, added up
in each task before they are shuffled, so a cluster with most of the vectors is no hot key.

Vectors with another number of components, a null or a non-finite one are left out.  Components are
``floor(scale * x)``, held within ``+-LARGEST`` so that a squared distance fits a long.  Repeated rows count each;
ties of ids among the starts are broken by the components; a null id starts last.  With fewer vectors than
centroids each starts one; an empty table gives an empty result.  Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, release

#: Components beyond this are cut to it: 64 * (2 * 2**26)**2 is below 2**63.
LARGEST = 1 << 26
#: Bounds kept at first, as a share of the centroids, and at least afterwards.
FIRST_SHARE, LEAST_SHARE = 4, 8
#: Bounds are rounded outwards by this share.
SLACK = 1e-12
#: Vectors that are compared with all centroids at once.
BLOCK = 4096

STATE = "vec_id long, code array<int>, cluster int, was int, upper double, near array<int>, lower array<double>, rest double, distance long, used int"


def codes(vector: Column, dim: int, scale: float) -> Column:
    """Whole components of a vector, or null if the vector is not of ``dim`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    )
    return F.when((F.size(vector) == dim) & finite, whole)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    largest = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(largest) ** 2 < 1 << 53:  # all partial sums are whole doubles
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


class Bounds:
    """The bounds of one batch of vectors."""

    def __init__(self, x: np.ndarray, centroids: np.ndarray, kept: int):
        n, k = len(x), len(centroids)
        self.x, self.c, self.kept = x, centroids, min(kept, k - 1)
        self.cluster = np.full(n, -1, np.int64)
        self.distance = np.zeros(n, np.int64)
        self.upper, self.rest = np.zeros(n), np.full(n, np.inf)
        self.near = np.zeros((n, self.kept), np.int64)
        self.lower = np.zeros((n, self.kept))
        self.used = np.zeros(n, np.int64)

    def scan(self, rows: np.ndarray) -> None:
        """All distances of these rows."""
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            d = _squared(self.x[part], self.c)
            order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
            ordered = np.take_along_axis(d, order, 1)
            roots = np.sqrt(ordered) * (1 - SLACK)
            self.cluster[part], self.distance[part] = order[:, 0], ordered[:, 0]
            self.near[part], self.lower[part] = order[:, 1 : self.kept + 1], roots[:, 1 : self.kept + 1]
            self.rest[part] = roots[:, self.kept + 1] if d.shape[1] > self.kept + 1 else np.inf
            self.used[part] = self.kept + 1
        self.upper[rows] = np.sqrt(self.distance[rows]) * (1 + SLACK)

    def take(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, moved: np.ndarray) -> None:
        """Bounds of the round before, loosened by how far each centroid has moved."""
        self.cluster = cluster.astype(np.int64)
        self.upper = upper * (1 + SLACK) + moved[self.cluster]
        kept = min(self.kept, near.shape[1])
        loosened = lower * (1 - SLACK) - moved[near] if near.shape[1] else lower
        # bounds that are no longer kept join the remainder
        self.rest = np.minimum(rest * (1 - SLACK) - moved.max(initial=0), loosened[:, kept:].min(axis=1, initial=np.inf))
        order = np.argsort(loosened[:, :kept], axis=1, kind="stable")
        self.near, self.lower = np.take_along_axis(near[:, :kept].astype(np.int64), order, 1), np.take_along_axis(loosened[:, :kept], order, 1)
        self.kept = kept

    def settle(self) -> None:
        """Make every cluster the nearest one, looking only at what the bounds leave open."""
        least = np.minimum(self.lower.min(axis=1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(~(self.upper < least))
        self.distance[open_] = _own(self.x[open_], self.c[self.cluster[open_]])
        self.upper[open_] = np.sqrt(self.distance[open_]) * (1 + SLACK)
        open_ = open_[~(self.upper[open_] < least[open_])]
        whole = ~(self.upper[open_] < self.rest[open_])
        self.scan(open_[whole])
        part = open_[~whole]
        if not len(part):
            return
        ask = ~(self.upper[part, None] < self.lower[part])
        self.used[part] = ask.sum(1)
        best, best_d = self.cluster[part].copy(), self.distance[part].copy()
        slot = np.full(len(part), -1)
        for j in range(self.kept):
            rows = np.flatnonzero(ask[:, j])
            if not len(rows):
                continue
            at = part[rows]
            number = self.near[at, j]
            d = _own(self.x[at], self.c[number])
            self.lower[at, j] = np.sqrt(d) * (1 - SLACK)
            better = (d < best_d[rows]) | ((d == best_d[rows]) & (number < best[rows]))
            won = rows[better]
            best[won], best_d[won], slot[won] = number[better], d[better], j
        won = np.flatnonzero(slot >= 0)
        at = part[won]
        self.near[at, slot[won]] = self.cluster[at]
        self.lower[at, slot[won]] = np.sqrt(self.distance[at]) * (1 - SLACK)
        self.cluster[at], self.distance[at] = best[won], best_d[won]
        self.upper[at] = np.sqrt(best_d[won]) * (1 + SLACK)

    def exact(self) -> None:
        """The distance to the own centroid, also where the bounds spared it."""
        self.distance = _own(self.x, self.c[self.cluster])


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width) if width else np.zeros((len(column), 0), kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if values.shape[1] else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.reshape(-1), kind))


def _assigned(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, kept: int, last: bool) -> DataFrame:
    """The state of the next round; ``moved`` is None in the first, whose rows are vec_id and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            x = _matrix(table["code"], centroids.shape[1], np.int64)
            bounds = Bounds(x, centroids, kept)
            if moved is None:
                was = pa.nulls(len(x), pa.int32())
                bounds.scan(np.arange(len(x)))
            else:
                was = table["cluster"].combine_chunks()
                width = len(table["near"][0])
                bounds.take(
                    was.to_numpy(), table["upper"].to_numpy(), _matrix(table["near"], width, np.int64),
                    _matrix(table["lower"], width, np.float64), table["rest"].to_numpy(), moved,
                )
                bounds.settle()
            if last:
                bounds.exact()
            columns = {
                "vec_id": table["vec_id"].combine_chunks(), "code": table["code"].combine_chunks(), "cluster": pa.array(bounds.cluster, pa.int32()),
                "was": was, "upper": pa.array(bounds.upper), "near": _lists(bounds.near, pa.int32()), "lower": _lists(bounds.lower, pa.float64()),
                "rest": pa.array(bounds.rest), "distance": pa.array(bounds.distance, pa.int64()), "used": pa.array(bounds.used, pa.int32()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, STATE)


def _changes(state: DataFrame, dim: int) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """What the vectors that changed cluster add to its count and sums, and the most bounds that one used."""
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    moved = state.where("was IS NULL OR was <> cluster").select("code", F.explode(sides).alias("x")).where("x.c IS NOT NULL")
    sums = [F.sum(F.get("code", k).cast("long") * F.col("x.sign")).alias(f"s{k}") for k in range(dim)]
    rows = moved.groupBy("x.c").agg(F.sum("x.sign").alias("n"), *sums).collect()  # a row for each centroid
    used = state.agg(F.max("used")).first()[0] or 0
    return {r["c"]: (r["n"], [r[f"s{k}"] for k in range(dim)]) for r in rows}, used


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1,
            vector: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster and squared distance of each kept vector; the centroids; the bounds kept in each round).

    The centroids start as the ``k`` vectors whose sha256 of ``seed:vec_id`` is smallest.
    """
    kept_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), codes(F.col(vector), dim, scale).alias("code")).where("code IS NOT NULL")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = kept_rows.select("code", rank.alias("h")).orderBy(F.col("h").asc_nulls_last(), "code").limit(k).collect()
    if not starts:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long")
        return empty, [], []
    centroids = np.array([r["code"] for r in starts], np.int64)
    counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    bounds = max(1, len(centroids) // FIRST_SHARE)
    state = materialise(_assigned(kept_rows, centroids, None, bounds, last=rounds == 0), "clusters")
    history = [bounds]
    for turn in range(rounds):
        changed, used = _changes(state, dim)
        for c, (n, delta) in changed.items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], delta)]
        fresh = np.array([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(len(centroids))], np.int64)
        moved = np.sqrt(_own(fresh, centroids)) * (1 + SLACK)
        if turn:
            bounds = max(1, len(centroids) // LEAST_SHARE, min(bounds, used))
        history.append(bounds)
        after = materialise(_assigned(state, fresh, moved, bounds, last=turn == rounds - 1), "clusters")
        release(state)
        state, centroids = after, fresh
    return state.select("vec_id", "cluster", "distance"), centroids.tolist(), history


def digest(components: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256: one small row for each centroid is joined."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    most = 2**63 - 1
    total = min(most, sum(int(r["s"]) for r in sums))
    rows = [(r["cluster"], min(most, int(r["s"])), total, digest(centroids[r["cluster"]])) for r in sums]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return assigned.join(F.broadcast(assigned.sparkSession.createDataFrame(rows, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
