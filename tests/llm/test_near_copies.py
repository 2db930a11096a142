import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import near_copies, simhash


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def edited(n=40):
    """Documents of 400 words, each with a copy that has 1 to 8 words replaced, and one that has 30 replaced."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 8))) for _ in range(2000)]
    rows = []
    for k in range(n):
        words = rng.choices(vocabulary, k=400)
        rows.append((3 * k, " ".join(words)))
        for j, changes in ((1, 1 + k % 8), (2, 30)):
            copy = list(words)
            for at in rng.sample(range(400), changes):
                copy[at] = "".join(rng.choices("bcfgjkmpqvwxyz", k=7))
            rows.append((3 * k + j, " ".join(copy)))
    return rows


def test_the_stage_removes_edited_copies_that_fingerprints_miss(spark):
    rows = edited()
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    near = {i for i in texts if i % 3 == 1 and jaccard(texts[i], texts[i - 1]) >= 0.8}
    assert len(near) == 40 and not any(jaccard(texts[i], texts[i - i % 3]) >= 0.8 for i in texts if i % 3 == 2)
    assert near & {r.doc_id for r in simhash.keep_one(df).collect()}
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, df, "").collect()} == set(texts) - near


def test_links_of_sets_against_brute_force():
    rng = random.Random(2)
    texts = []
    for _ in range(30):
        words = [str(rng.random()) for _ in range(60)]
        for _ in range(4):
            texts.append(" ".join(words))
            words[rng.randrange(60)] = str(rng.random())
    sets = [near_copies.shingles(near_copies.words_of(t)) for t in texts]

    def groups(pairs):
        parent = list(range(len(texts)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
        return [root(i) for i in range(len(texts))]

    n = len(texts)
    want = groups((i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8)
    found = near_copies.alike_links(sets)
    assert groups(found) == want and len(found) == n - len(set(want))


def chained(n_groups=3, length=60):
    """Chains of documents, each with one word more changed than the one before, and balls around one document."""
    rng = random.Random(9)
    rows = []
    for g in range(n_groups):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(length):  # a chain
            rows.append(" ".join(words))
            for at in rng.sample(range(120), 2 + g):
                words[at] = f"c{rng.randrange(10**6)}"
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(length):  # a ball, in part too far from its centre
            copy = list(words)
            for at in rng.sample(range(120), rng.randint(0, 5)):
                copy[at] = f"b{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return rows


def roots_of(nodes, pairs):
    parent = {i: i for i in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize(("block", "n_pivots"), [(8, 2), (40, 16), (256, 16)])
def test_groups_beyond_a_block_lose_no_link(spark, monkeypatch, block, n_pivots):
    monkeypatch.setattr(near_copies, "PIVOTS", n_pivots)
    texts = dict(enumerate(chained()))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    text = F.col("text")
    marked = df.select(
        F.col("doc_id").alias("k_id"), F.xxhash64(text).alias("text_hash"), F.col("doc_id").alias("fp"), F.length(text).alias("n_chars"),
        near_copies.sketches(text).alias("s"),
    ).select("k_id", "text_hash", "fp", "n_chars", "s.*")
    found = near_copies.near_links(df, marked, simhash.components, block=block)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in pairs)
    first = {}  # equal texts are one node
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    nodes = sorted(first.values())
    sets = {i: shingle_set(texts[i]) for i in nodes}
    links = [(i, j) for i in nodes for j in nodes if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert roots_of(nodes, pairs) == roots_of(nodes, links)


def test_a_block_holds_a_bounded_part_of_a_group(spark):
    rows = [(k, 1, 10) for k in range(5000)] + [(k, 2, 10) for k in range(5000, 5100)]
    dealt = near_copies.in_blocks(spark.createDataFrame(rows, "key long, root long, n_chars int"), 256)
    sizes = {(r.root, r.block): r["count"] for r in dealt.select("root", F.explode("at").alias("block")).groupBy("root", "block").count().collect()}
    assert sum(sizes.values()) == 5000 + 19 * near_copies.PIVOTS + 100 and len(sizes) == 21
    assert max(sizes.values()) < 2 * 256
