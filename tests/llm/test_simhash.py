import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import registry, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, radius=2):
    points = sorted(points)
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    array = np.array(points, np.uint64)
    for p in points:
        for q in array[np.bitwise_count(array ^ np.uint64(p)) <= radius].tolist():
            a, b = sorted((root(p), root(q)))
            parent[b] = a
    return {p: root(p) for p in points}


def expected(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    roots = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for i, f in fps), key=repr)


def clustered(n, seed=1):
    rng = random.Random(seed)
    points = {rng.getrandbits(64) for _ in range(n)}
    for p in list(points)[: n // 4]:  # chains and balls of near values
        q = p
        for _ in range(rng.randint(1, 6)):
            q ^= 1 << rng.randint(0, 63)
            points.add(q)
            points.add(p ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)))
    return points


def test_query(spark, small, docs):
    want = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, registry.op6_simhash(spark, small).collect()), key=repr) == want


def test_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.simhash_components(odd).collect()), key=repr) == expected(rows)
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


@pytest.mark.parametrize(("n", "leaf"), [(3000, 16), (3000, 64), (500, 8)])
def test_neighbours_lose_no_link(n, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    points = clustered(n)
    a, b = simhash.neighbours(np.array(sorted(points), np.uint64), 2)
    edges = dict.fromkeys(points)
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    assert {p: root(p) for p in edges} == brute_components(points)


def test_shards_and_stars_lose_no_link(spark, monkeypatch):
    points = clustered(2500, 3)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    edges = simhash.links(df, shard=200)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(points)
    groups = {}
    for p in points:
        signed = p - (1 << 64) if p >> 63 else p
        groups.setdefault(want[p], set()).add(roots.get(signed, signed))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_dense_ball_stays_linear(spark):
    rng = random.Random(4)
    ball = {sum(1 << b for b in rng.sample(range(40), 3)) for _ in range(3000)}
    df = spark.createDataFrame([(p,) for p in ball], "fp long")
    assert simhash.links(df, shard=500).count() < 40 * len(ball)


def test_long_chains(spark):
    chain = spark.range(400).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = simhash.components(chain).collect()
    assert len(got) == 400 and {r.root for r in got} == {0}


def test_one_of_each_group_stays(docs):
    want = {c for _, _, c in expected([tuple(r) for r in docs.select("doc_id", "text").collect()])}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == want


def test_repeated_rows_count_once(odd):
    got = simhash.keep_one(odd).collect()
    assert len(got) == len({(r.doc_id, r.text) for r in got})
    assert {r.doc_id for r in got} >= {1, 2, 5, 6, 8, 9}
