"""SimHash near-duplicates through vantage-point trees.

Fingerprints are taken over word shingles.  Their distinct values are dealt to shards by a vantage-point
tree that the driver builds over a bounded sample: an inner node holds a vantage fingerprint and a radius,
and a fingerprint goes inside when it lies within the radius.  By the triangle inequality a pair at most
``radius`` bits apart can only be split when the inner one lies within ``radius`` of the border, so those
fingerprints go to both sides: every linked pair meets in at least one shard.  A shard goes on splitting
in the same way until its parts are small, and then finds exact neighbours.

A shard hands on a forest instead of pairs: each fingerprint with one representative it is linked to, so
the output is linear in what the shard got.  Connected components of these links follow by alternating
stars, each round written to the shared folder.  The tree's sample grows with the distinct fingerprints, so
shards stay alike up to ``MOST_SAMPLE / SHARD_SAMPLE`` of them; beyond that they grow in proportion.

A null text counts as empty; an empty text has fingerprint zero, linked like any other.  An empty table gives none.  Null ids never name a component; a component
of null ids only has a null id.  Repeated rows keep one row each.  Extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import near_copies
from pulsegrid.llm.common import join_on_key, materialise, release, small_batches

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints of a shard, about, and the sampled ones that tell how to cut it.
SHARD = 5_000
SHARD_SAMPLE = 16
#: Least and most fingerprints that the driver samples to build the tree: a minute's work and some 200,000 nodes at most.
SAMPLE = 20_000
MOST_SAMPLE = 131_072
#: A part of a shard this small is searched directly.
LEAF = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that are held at once while bits are counted.
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    h, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(words[i:] for i in range(k))))
    hashes = np.fromiter((h(s, seed) for s in shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for a in range(0, n, _STEP):
        raw = hashes[a : a + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of each text, as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return of(text.cast("string"))


def split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """(vantage, border, inside, outside), each with what lies near the border; None if nothing is gained."""
    best = None
    for vantage in points[rng.integers(0, len(points), 4)]:
        d = np.bitwise_count(points ^ vantage).astype(np.int64)
        border = int(np.median(d))
        for edge in (border - 1, border):
            inside, both = d <= edge, (d <= edge) & (d > edge - radius)
            n_in, n_out = int(inside.sum()), int((~inside | both).sum())
            if best is None or n_in**2 + n_out**2 < best[0]:
                best = (n_in**2 + n_out**2, vantage, edge, inside, ~inside | both)
    if best is None or best[0] > 0.9 * len(points) ** 2:
        return None
    return best[1], best[2], best[3], best[4]


def build_tree(sample: np.ndarray, leaf: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, border, inside, outside); a child below 0 is shard ``-1 - child``."""
    rng = np.random.default_rng(5)
    nodes: list[tuple[int, int, int, int]] = []
    shards = 0

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        found = split(points, radius, rng) if len(points) > leaf else None
        if found is None:
            shards += 1
            return -shards
        vantage, border, inside, outside = found
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        nodes[at] = (int(vantage), border, grow(points[inside]), grow(points[outside]))
        return at

    grow(sample)
    return nodes


def place(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points) for every shard that some points may have neighbours in."""
    todo = [(0 if nodes else -1, points)]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if at < 0:
            yield -1 - at, own
            continue
        vantage, border, inside, outside = nodes[at]
        d = np.bitwise_count(own ^ np.uint64(vantage)).astype(np.int64)
        todo.append((inside, own[d <= border]))
        todo.append((outside, own[d > border - radius]))


def neighbours(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct points: those linked to a representative, and that representative.

    A part that a vantage point splits is searched in its two overlapping halves.  In a part that is small,
    or that does not split, links are followed from point to point; each point is compared with those not
    yet reached, and no list of pairs is kept.
    """
    rng = np.random.default_rng(len(points))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [points]
    while todo:
        own = todo.pop()
        halves = split(own, radius, rng) if len(own) > LEAF else None
        if halves is not None:
            todo += [own[halves[2]], own[halves[3]]]
            continue
        rest = own
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            front = [root]
            while front and len(rest):
                near = np.bitwise_count(rest ^ front.pop()) <= radius
                if near.any():
                    linked, rest = rest[near], rest[~near]
                    found.append((linked, np.full(len(linked), root)))
                    front.extend(linked)
    if not found:
        return points[:0], points[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): a forest whose components are those of all pairs of ``fp`` at most ``radius`` bits apart."""
    n = distinct.count()
    size = min(MOST_SAMPLE, max(SAMPLE, SHARD_SAMPLE * n // shard))
    share = min(1.0, 1.2 * size / max(1, n))
    # xxhash64 of the value picks the sample, so it is the same whenever a part is computed again.
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(size)
    sample = picked.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaf = max(SHARD_SAMPLE, int(shard * max(1, len(sample)) / max(1, n)))
    nodes = build_tree(np.sort(sample), leaf, radius) if n > shard else []

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at, own in place(pdf["fp"].to_numpy(np.int64).view(np.uint64), nodes, radius):
                yield pd.DataFrame({"shard": np.full(len(own), at), "fp": own.view(np.int64)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = neighbours(np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64)), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInPandas(deal, "shard int, fp long")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component of ``edges`` (a, b), for every node but the roots.

    Large and small stars alternate until nothing changes: every node points to the least node it knows, and
    its neighbours follow.  Neighbours are gathered as minima only, never as lists, and those of a hub stay
    spread over the tasks that they are in.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = materialise(edges.where("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "links")
    tally = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    before = edges.agg(*tally).first()
    while before["n"]:
        total = 2 * before["n"]
        # Large star: of each node, the larger neighbours are tied to the least of all (or the node itself).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("n"))
        large = join_on_key(both.where("b > a"), low, "a", total).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialise(large.where("a <> b"), "links")
        release(edges)
        # Small star: the smaller neighbours, and the node, are tied to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = join_on_key(large, low, "a", total).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        edges = small.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        edges = materialise(edges, "links")
        release(large)
        state = edges.agg(*tally).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _marked(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprints(text, shingle).alias("fp"), F.xxhash64(text).alias("text_hash"))
    return materialise(rows, "fingerprints")


def _labelled(marked: DataFrame, radius: int, further: DataFrame | None = None) -> DataFrame:
    """``marked`` with component_id; ``further`` has links (a, b) of fingerprints besides those within ``radius``."""
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")), "distinct")
    linked = links(distinct, radius)
    roots = components(linked if further is None else linked.unionByName(further))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    known = materialise(known.select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root")), "roots")
    totals = known.agg(F.count("*").alias("fps"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    labels = join_on_key(known, least, "root", totals["fps"]).select("fp", "component_id", F.col("n_rows").alias("n"))
    return join_on_key(marked, materialise(labels, "labels"), "fp", totals["rows"])


def simhash_components(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (its least doc_id)."""
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    labelled = _labelled(_marked(docs, shingle, id_col, text_col), radius)
    return labelled.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, alike: float | None = None) -> DataFrame:
    """The document with the least id of each component, with its own columns.

    Rows equal in id and text count once.  A null id stays only where no document of its component has one.
    With ``alike``, documents whose five-word shingles are at least that similar are linked as well.
    """
    small_batches(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    further = None
    if alike is None:
        marked = _marked(docs, shingle, "doc_id", "text")
    else:
        text = F.col("text")
        rows = docs.select("doc_id", fingerprints(text, shingle).alias("fp"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("n_chars"), near_copies.sketches(text).alias("s"))
        marked = materialise(rows.select("doc_id", "fp", "text_hash", "n_chars", "s.*"), "fingerprints")
        further = near_copies.near_links(docs, marked.withColumn("k_id", key), components, alike)
        marked = marked.drop("key", "bands", "n_chars")
    labelled = _labelled(marked, radius, further)
    firsts = labelled.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = firsts.select(key.alias("__keep_id"), F.col("text_hash").alias("__keep_text")).distinct()
    keyed = docs.withColumn("__keep_id", key).withColumn("__keep_text", F.xxhash64("text"))
    names = ["__keep_id", "__keep_text"]
    return keyed.join(firsts, names, "left_semi").dropDuplicates(names).select(*docs.columns)
