import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def want_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """The rounds as stated: share by weight, stop at the cap, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, got, total = set(sizes), {}, share * sum(sizes.values())
    while left:
        rest = total - sum(got.values())
        level = rest / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s]}
        if not over:
            return got | {s: level * w[s] for s in left}
        got |= {s: float(most * sizes[s]) for s in over}
        left -= over
    return got


def check(docs, got):
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    targets = want_targets(dict(sizes))
    for r in got.collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(targets[s], rel=1e-9)
        assert r.taken in {0, r.size, 2 * r.size}
        assert r.taken >= int(r.target // max(1, r.source_size)) * r.size, "whole epochs first"
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6, s


def test_query(spark, small, docs):
    got = registry.op8_mixing(spark, small)
    check(docs, got)
    again = registry.op8_mixing(spark, small)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_sizes(docs):
    want = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n for r in docs.select("doc_id", mixing.size_of(F.col("text")).alias("n")).collect()} == want


def test_hot_source_and_odd_rows(spark, odd, empty):
    rows = [(k, "w " * (1 + k % 50), "hot" if k % 3 else ("s%d" % (k % 5) if k % 7 else None)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs, mixing.mix_table(docs))
    assert mixing.mix_table(odd).count() == odd.count()
    assert mixing.mix_table(empty).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_ranges_cut_again_and_many_sources(spark, monkeypatch):
    rows = [(k, "w " * (1 + k % 50), "hot" if k % 3 else "s%d" % (k % 40)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix_table(docs).collect()))
    monkeypatch.setattr(mixing, "SORT_ROWS", 2)
    monkeypatch.setattr(mixing, "STEP_BITS", 4)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix_table(docs).collect())) == want


def test_mix_repeats_rows_as_often_as_taken(docs):
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.mix_table(docs).collect() if r.size and r.taken})
    got = Counter(r.doc_id for r in mixing.mix(docs).where("text <> ''").collect())
    assert {k: v for k, v in got.items() if k in want} == dict(want)


def test_better_documents_come_first(spark):
    text = {0: "plain words " * 5, 1: "#$% words** " * 5}
    docs = spark.createDataFrame([(k, text[k % 2], "ab"[k % 2 if k < 10 else 0]) for k in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix_table(docs, share=0.3, weights=(1.0,)).toPandas()
    took = got.groupby(got.doc_id % 2).taken.sum()
    assert took[0] > 1.5 * took[1]


def test_plan_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_force(rows, seed=17, parts=(5, 2, 1)):
    """{place of the row: copies}: keys by the same hash, each source sorted whole, the prefix nearest to the target."""
    import math
    import struct

    import xxhash

    def hashed(*values):
        h = 42
        for v in values:
            if v is None:
                continue
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if v is seed else "<q", v), h)
        return h

    sizes, by = defaultdict(int), defaultdict(list)
    for at, (doc_id, text, source) in enumerate(rows):
        size = len(WORD.findall(text or ""))
        symbols = len(re.findall(r"[#*$%&|<>{}=\\^~]", text or ""))
        u = ((hashed(seed, doc_id, text) >> 11) + 0.5) / 2.0**53
        by[source].append((-math.log(u) / (1.0 / (1.0 + symbols / max(size, 1))), size, at))
        sizes[source] += size
    targets, copies = want_targets(dict(sizes), parts), {}
    for source, own in by.items():
        epochs = int(targets[source] // sizes[source]) if sizes[source] else 0
        room, so_far = targets[source] - epochs * sizes[source], 0
        own.sort()
        for key, size, at in own:
            mates = sum(s for k, s, _ in own if k == key)  # rows equal in id and text share a key
            if key != (own[own.index((key, size, at)) - 1][0] if own.index((key, size, at)) else None):
                so_far += mates
            copies[at] = epochs + (sizes[source] > 0 and room > 0 and so_far - mates / 2 <= room)
    return copies


def test_choice_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    copies = brute_force(rows)
    want = sorted((doc_id, len(WORD.findall(text or "")) * copies[at]) for at, (doc_id, text, _) in enumerate(rows))
    assert sorted((r.doc_id, r.taken) for r in mixing.mix_table(docs).collect()) == want
    taken = defaultdict(int)
    for r in mixing.mix(docs).select("doc_id", "text").collect():
        taken[(r.doc_id, r.text)] += 1
    want = defaultdict(int)
    for at, (doc_id, text, _) in enumerate(rows):
        want[(doc_id, text)] += copies[at]
    assert taken == {k: n for k, n in want.items() if n}
