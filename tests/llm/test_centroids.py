import hashlib
import math

import numpy as np
import pytest

from pulsegrid.llm import centroids, registry


def plain(rows, k, rounds, dim, scale, seed=1):
    """The stated rounds, by all distances."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    rank = [("g" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept]
    found = [v for _, v in sorted(rank)[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in found]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        by = {}
        for _, v, c, _ in assign():
            by.setdefault(c, []).append(v)
        found = [[sum(x) // len(by[c]) for x in zip(*by[c])] if c in by else m for c, m in enumerate(found)]
    return sorted((i, c, d) for i, _, c, d in assign() if i is not None), found


def blobs(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, dim))
    return [(i, (middles[i % 9] * spread + rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "extra", 1.0) for i, v in rows], SCHEMA)


def got(spark, rows, **how):
    assigned, found, history = centroids.cluster(frame(spark, rows), **how)
    return sorted(map(tuple, assigned.where("vec_id IS NOT NULL").collect())), found, history


@pytest.mark.parametrize(("k", "rounds", "scale"), [(16, 3, 64.0), (20, 8, 8.0), (2, 4, 64.0), (1, 2, 64.0), (5, 0, 64.0)])
def test_equals_plain_rounds(spark, k, rounds, scale):
    rows = blobs(400, 6, k)
    have, found, history = got(spark, rows, k=k, rounds=rounds, dim=6, scale=scale)
    want, middles = plain(rows, k, rounds, 6, scale)
    assert have == want and found == middles
    assert len(history) == rounds + 1 and history == sorted(history, reverse=True)


def test_ties_and_copies(spark):
    """Whole numbers on a small grid: many equal distances, and a third of all rows are one vector."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)] + [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(100)]
    rows += rows[:7]
    have, found, _ = got(spark, rows, k=9, rounds=5, dim=4, scale=1.0)
    want, middles = plain(rows, 9, 5, 4, 1.0)
    assert have == want and found == middles


def test_odd_rows(spark):
    bad = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 0.0, 0.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0])]
    rows = blobs(30, 4, 1) + bad + [(None, [0.5, 0.5, 0.5, 0.5]), (None, [0.5, 0.5, 0.5, 0.5])]
    have, found, _ = got(spark, rows, k=4, rounds=3, dim=4, scale=64.0)
    want, middles = plain(rows, 4, 3, 4, 64.0)
    assert have == want and found == middles
    assert len(got(spark, rows[:3], k=16, rounds=3, dim=4)[1]) == 3, "fewer vectors than centroids"
    assert got(spark, [], k=16, rounds=3, dim=4) == ([], [], []) and got(spark, bad, k=2, dim=4) == ([], [], [])
    assigned, found, _ = centroids.cluster(frame(spark, []), dim=4)
    assert centroids.with_inertia(assigned, found).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    far = [(1, [1e300, -1e300]), (2, [0.0, 0.0])]
    assert [d for _, _, d in got(spark, far, k=1, rounds=1, dim=2)[0]] == [2 * (centroids.LARGEST // 2) ** 2] * 2


def test_bounds_spare_distances():
    """Where centroids hardly move, most vectors keep theirs unseen, and the answer is that of a scan."""
    x = np.array([np.floor(np.array(v) * 64) for _, v in blobs(2000, 8, 3)], np.int64)
    c = x[:12]
    first = centroids.Bounds(x, c, 3)
    first.scan(np.arange(len(x)))
    moved = c + np.random.default_rng(1).integers(-1, 2, c.shape)
    step = np.sqrt(((moved - c) ** 2).sum(1))
    after = centroids.Bounds(x, moved, 2)
    after.take(first.cluster, first.upper, first.near, first.lower, first.rest, step)
    after.settle()
    after.exact()
    d = centroids._squared(x, moved)
    assert (after.cluster == d.argmin(1)).all() and (after.distance == d.min(1)).all()
    assert (after.used == 0).mean() > 0.7


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    want, middles = plain([(r.vec_id, r.embedding) for r in rows], 16, 3, 64, 64.0)
    have = registry.op11_centroids(spark, small).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in have) == want
    for r in have:
        assert r.inertia == sum(d for *_, d in want)
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middles[r.cluster])).encode()).hexdigest()
