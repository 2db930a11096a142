"""Edited near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash: ``BANDS`` bands of ``ROWS`` minima, so that a pair of similarity s meets with
probability 1 - (1 - s**ROWS)**BANDS (0.99985 at 0.8).  A band ties its documents to the least of them only,
first within each batch and then between batches, so that one shuffle with at most a row for each batch and band
is enough.  Components of these ties are the groups that are searched: inside a group the shingle sets themselves
are compared, and links are followed from document to document as in ``simhash.neighbours``.

A group is cut into blocks of a bounded size, and a task searches one block.  Each block of a large group also
gets the same few pivots of that group, so the links inside the blocks tie nearly all of a group of copies
together.  What is not tied to the largest class of its group (the strays) is then held against every block of
the group: two documents of different classes are never both in the largest one, so no link is lost.

Texts equal but for ASCII case and white space count once.  A text without a word has no shingle and no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import join_on_key, materialise, release

#: Words of a shingle, and the least similarity of near copies.
SHINGLE = 5
ALIKE = 0.8
BANDS = 48
ROWS = 8
SEED = 42
#: Documents and characters of a block, about, and the pivots that all blocks of one group share.
BLOCK = 256
BLOCK_CHARS = 1 << 24
PIVOTS = 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that are multiplied at once.
_STEP = 512


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``words``."""
    import xxhash

    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    found = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.unique(np.fromiter((h(s, SEED) for s in found), np.uint64, len(words) - k + 1))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band, different from band to band; none without a shingle."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[a : a + _STEP, None] * _FACTORS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _PRIME
        keys ^= keys >> np.uint64(29)
    return keys


def sketches(text: Column) -> Column:
    """struct<key, bands>: the hash of the words of each text, and its band keys."""

    @F.pandas_udf("key long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        keys, bands = [], []
        for text in texts:  # one at a time: the words of a whole batch would take ten times its text
            words = words_of(text)
            keys.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            bands.append(band_keys(shingles(words)).view(np.int64))
        return pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "bands": bands})

    return of(text.cast("string"))


def alike_links(sets: list[np.ndarray], alike: float = ALIKE) -> list[tuple[int, int]]:
    """(i, j): a forest whose components are those of all pairs of sets at least ``alike`` similar."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    out: list[tuple[int, int]] = []
    left = np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            keep = left[owner]
            owner, values = owner[keep], values[keep]
            if not len(owner):
                return out
            own = sets[at := front.pop()]
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            both = np.bincount(owner[own[place] == values], minlength=len(sets))
            linked = np.flatnonzero(left & (both >= alike * (sizes + len(own) - both) - 1e-9))
            left[linked] = False
            out += [(i, at) for i in linked.tolist()]
            front += linked.tolist()
    return out


def band_ties(marked: DataFrame) -> DataFrame:
    """(a, b): keys that share a band, tied to the least key of that band; ``marked`` has key and bands.

    Of a band that many documents share, each batch sends only its least key, so no task gets them all."""

    def combined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands in order, their keys in order, and the place where each row's band begins."""
        sizes = pdf["bands"].map(len).to_numpy(np.int64)
        if not sizes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        band, key = np.concatenate(pdf["bands"].to_list()).astype(np.int64), np.repeat(pdf["key"].to_numpy(np.int64), sizes)
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        first = np.r_[True, band[1:] != band[:-1]]
        return band, key, np.maximum.accumulate(np.where(first, np.arange(len(band)), 0))

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            _, key, first = combined(pdf)
            yield pd.DataFrame({"a": key, "b": key[first]}).query("a != b").drop_duplicates()

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            band, key, first = combined(pdf)
            at = np.unique(first)
            yield pd.DataFrame({"band": band[at], "key": key[at]})

    rows = marked.select("key", "bands")
    low = F.min("key").over(Window.partitionBy("band"))
    between = rows.mapInPandas(least, "band long, key long").select(F.col("key").alias("a"), low.alias("b"))
    return rows.mapInPandas(inside, "a long, b long").unionByName(between.where("a <> b"))


def _sets(texts: pd.Series) -> list[np.ndarray]:
    return [shingles(words_of(t)) for t in texts]


def _blocks(n, chars, block: int) -> Column:
    """How many blocks ``n`` documents with ``chars`` characters fill, at least one."""
    return F.greatest(F.ceil(n / block), F.ceil(chars / BLOCK_CHARS), F.lit(1)).cast("int")


def _pick(of: Column, seed: str) -> Column:
    """A block from 0 on for each key, of as many as ``of`` says."""
    return F.pmod(F.xxhash64("key", F.lit(seed)), of.cast("long")).cast("int")


def in_blocks(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """``candidates`` (key, root, n_chars and more) with ``blocks``, the own ``block``, and ``at``: all blocks to be in."""
    sizes = candidates.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    sizes = sizes.select("root", "n", _blocks(F.col("n"), F.col("chars"), block).alias("blocks"))
    rows = join_on_key(candidates, sizes, "root", candidates.count()).withColumn("block", _pick(F.col("blocks"), "block"))
    # The rank is limited before the shuffle, so no task gets a whole group.
    ranked = rows.where((F.col("blocks") > 1) & (F.col("n_chars") <= BLOCK_CHARS // (4 * PIVOTS)))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("key")))
    pivots = ranked.where(F.col("rank") <= PIVOTS).select("key", F.lit(True).alias("pivot"))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    return rows.join(pivots, "key", "left").withColumn("at", F.when(F.col("pivot"), everywhere).otherwise(F.array("block"))).drop("pivot")


def stray_links(texts: DataFrame, members: DataFrame, links: DataFrame, components, alike: float, block: int) -> DataFrame | None:
    """(a, b) between the classes that ``links`` (ka, kb) leave in each large group; None if each has one class.

    ``texts`` has the text and fp of each key of ``members``."""
    roots = components(links.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    classes = members.join(roots.select(F.col("node").alias("key"), F.col("root").alias("cls")), "key", "left")
    classes = materialise(classes.withColumn("cls", F.coalesce("cls", "key")), "classes")
    sizes = classes.groupBy("root", "cls").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    most = F.max(F.struct("n", "chars", "cls"))
    left = sizes.groupBy("root").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    n, chars = F.col("n") - F.col("most.n"), F.col("chars") - F.col("most.chars")
    left = left.where(n > 0).select("root", F.col("most.cls").alias("largest"), _blocks(n, chars, block).alias("chunks"), "n")
    left = materialise(left, "strays")
    if left.isEmpty():
        return None
    rows = join_on_key(classes, left, "root", classes.count())
    one = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("block").alias("block"), c.alias("chunk"), F.lit(False).alias("stray")))
    own = _pick(F.col("chunks"), "chunk")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), own.alias("chunk"), F.lit(True).alias("stray")))
    rows = rows.withColumn("to", F.when(F.col("cls") == F.col("largest"), one).otherwise(F.concat(one, every)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["key", "stray"])
        held, strays = pdf[~pdf["stray"]], pdf[pdf["stray"]]
        out: list[tuple[int, int]] = []
        if len(held) and len(strays):
            sets = _sets(held["text"])
            sizes = np.array([len(s) for s in sets], np.int64)
            owner, values = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
            cls, fp = held["cls"].to_numpy(np.int64), held["fp"].to_numpy(np.int64)
            for own_cls, own_fp, text in zip(strays["cls"], strays["fp"], strays["text"]):
                own_set = shingles(words_of(text))
                place = np.minimum(np.searchsorted(own_set, values), len(own_set) - 1)
                both = np.bincount(owner[own_set[place] == values], minlength=len(sets))
                near = np.flatnonzero((cls != own_cls) & (both >= alike * (sizes + len(own_set) - both) - 1e-9))
                # One link to each class is enough: what is in it is tied together already.
                out += [(own_fp, b) for b in fp[near[np.unique(cls[near], return_index=True)[1]]].tolist()]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    dealt = texts.select("key", "fp", "text").join(rows.select("root", "key", "cls", "to"), "key")
    dealt = dealt.select("root", "key", "fp", "cls", "text", F.explode("to").alias("t"))
    dealt = dealt.select("root", "key", "fp", "cls", "text", "t.block", "t.chunk", "t.stray")
    found = materialise(dealt.groupBy("root", "block", "chunk").applyInPandas(search, "a long, b long"), "near")
    release(classes)
    release(left)
    return found


def near_links(docs: DataFrame, marked: DataFrame, components, alike: float = ALIKE, block: int = BLOCK) -> DataFrame:
    """(a, b): fingerprints ``fp`` of near copies in ``docs``; their components are those of all linked pairs.

    ``marked`` has k_id, text_hash, n_chars, fp, key and bands of each row of ``docs``; ``components`` turns
    links (a, b) into (node, root).
    """
    first = F.min(F.struct("k_id", "text_hash", "fp", "n_chars")).alias("f")
    distinct = marked.where(F.size("bands") > 0).groupBy("key").agg(first)
    groups = components(band_ties(marked))
    groups = groups.select(F.col("node").alias("key"), "root").unionByName(groups.select(F.col("root").alias("key"), "root").distinct())
    candidates = materialise(groups.join(distinct, "key").select("key", "root", "f.*"), "candidates")
    members = materialise(in_blocks(candidates, block), "members")
    release(candidates)
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values("key")
        fp, key = pdf["fp"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64)
        i, j = np.array(alike_links(_sets(pdf["text"]), alike), np.int64).reshape(-1, 2).T
        return pd.DataFrame({"ka": key[i], "kb": key[j], "a": fp[i], "b": fp[j], "large": bool((pdf["blocks"] > 1).any())})

    # All documents are held against the candidates once; what is compared later is this table.
    texts = texts.join(members.select("k_id", "text_hash", "key", "root", "fp", "blocks", "at"), ["k_id", "text_hash"])
    texts = materialise(texts.drop("k_id", "text_hash"), "texts")
    dealt = texts.select("root", "key", "fp", "blocks", "text", F.explode("at").alias("block"))
    found = dealt.groupBy("root", "block").applyInPandas(search, "ka long, kb long, a long, b long, large boolean")
    found = materialise(found, "near")
    out, large = found.select("a", "b"), members.where("blocks > 1")
    if not large.isEmpty():
        further = stray_links(texts, large.select("key", "root", "blocks", "block", "n_chars"), found.where("large"), components, alike, block)
        out = out if further is None else out.unionByName(further)
    release(texts)
    release(members)
    return out
