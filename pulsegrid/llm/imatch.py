"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon keeps the terms whose document frequency lies in a band.  Each fingerprint sorts a
document's distinct lexicon terms and hashes the sorted list of those that lie in each of several random
subsets of the lexicon, whose rates fall by fours, so that for any length of document some subsets hold about one of its terms.
Two fingerprints are alike by the share of equal subset hashes, at the finest rate at which at least
a quarter of the subsets hold a term of either document.

Document frequencies cover all documents.  A term of the band lies in at least ``MIN_SHARE`` of them,
so the lexicon has at most (mean distinct terms of a document) / ``MIN_SHARE`` entries, at any corpus
size; it is counted before it is broadcast.

A document without a lexicon term is hashed by all its terms.  Null text counts as empty; empty texts
have equal fingerprints.  Repeated rows are compared row by row, null ids come last in descending order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.order import cuts_below

#: The band: least and greatest share of all documents that a lexicon term lies in, and the least number.
MIN_SHARE = 0.001
MAX_SHARE = 0.05
MIN_DOCS = 2
#: Lexicon subsets at each rate 4**-1 ... 4**-LEVELS.
SUBSETS = 32
LEVELS = 5
#: Terms that a broadcast lexicon may have; a larger one raises MIN_SHARE's bound as the cause.
MAX_LEXICON = 20_000_000
#: Documents of one bucket of neighbours, about.
BUCKET_DOCS = 1024
#: Distinct terms that a task counts before it hands the counts on.
HELD_TERMS = 1_000_000

_STRIP = ".,;:!?\"'()[]{}<>|*#$%&-_/\\"
_MIX = np.random.default_rng(20).integers(1, 1 << 63, SUBSETS, dtype=np.uint64) | np.uint64(1)
_EDGES = np.arange(SUBSETS + 1)
_RATES = [np.uint32(1 << (30 - 2 * level)) for level in range(LEVELS)]
#: Hex digits kept of a subset's 64-bit hash.
DIGITS = 8


def terms(text: str) -> set[str]:
    """Distinct words in lower case, without surrounding punctuation."""
    found = {w.strip(_STRIP) for w in set(text.lower().split())}
    found.discard("")
    return found


def hashes(found) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(t.encode("utf-8", "replace")) for t in found), np.uint64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term (64-bit hash) and the number of documents that have it."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame({"term": hashes(held).view(np.int64), "df": np.fromiter(held.values(), np.int64)})

        for pdf in frames:
            for text in pdf["text"]:
                for t in terms(text or ""):
                    held[t] = held.get(t, 0) + 1
                if len(held) > HELD_TERMS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """The sorted hashes of the terms in the band."""
    n = docs.count()
    band = document_frequencies(docs, text_col).where(F.col("df").between(max(MIN_DOCS, min_share * n), max_share * n))
    rows = band.select("term").limit(MAX_LEXICON + 1).toPandas()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"more than {MAX_LEXICON} lexicon terms: raise min_share")
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def fingerprint(text: str, words: np.ndarray) -> str:
    """Hex digits of the hash of each subset's sorted terms, rate by rate; zero where a subset holds none of them."""
    import xxhash

    all_terms = np.unique(hashes(terms(text)))
    if not len(all_terms):
        return "0" * (DIGITS * SUBSETS * LEVELS)
    if len(words):
        at = np.minimum(np.searchsorted(words, all_terms), len(words) - 1)
        own = all_terms[words[at] == all_terms]
    else:
        own = all_terms[:0]
    if not len(own):
        own = all_terms
    mixed = _MIX[:, None] * own[None, :]  # subset by subset, terms in order
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    draw = (mixed >> np.uint64(32)).astype(np.uint32).ravel()
    at = np.flatnonzero(draw < _RATES[0])
    draw, subset, term = draw[at], at // len(own), own[at % len(own)].astype("<u8")
    h, shift, out = xxhash.xxh64_intdigest, 64 - 4 * DIGITS, []
    for level, rate in enumerate(_RATES):  # a subset of a rate holds what those of the lower rates hold
        if level:
            keep = draw < rate
            draw, subset, term = draw[keep], subset[keep], term[keep]
        ends, raw = (8 * np.searchsorted(subset, _EDGES)).tolist(), term.tobytes()
        out += [(h(raw[a:b]) >> shift or 1) if b > a else 0 for a, b in zip(ends, ends[1:])]
    return "".join([f"%0{DIGITS}x" % v for v in out])


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    none = b"0" * DIGITS
    x = np.frombuffer(a.encode(), f"S{DIGITS}").reshape(LEVELS, SUBSETS)
    y = np.frombuffer(b.encode(), f"S{DIGITS}").reshape(LEVELS, SUBSETS)
    held = (x != none) | (y != none)
    informed = held.sum(axis=1)
    level = max(0, int(np.flatnonzero(4 * informed >= SUBSETS).max(initial=0)))
    return float(((x[level] == y[level]) & held[level]).sum() / informed[level]) if informed[level] else 0.0


def in_descending_order(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (bucket, edge, doc_id, text): inside a bucket ids fall, and the first row of the next bucket
    (edge 1) ends it; the first bucket's first row ends the last bucket.

    Buckets are ranges of ids between quantiles, 20,000 at most: beyond some 20 million documents they grow, and
    so do the rows of one repeated id, but rows stream through a bucket and none is held whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col(text_col).cast("string").alias("text"))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n = max(1, rows.count())
    parts = min(20_000, max(1, n // BUCKET_DOCS))
    cuts: list[int] = []
    if parts > 1:
        asked = F.percentile_approx(at, [k / parts for k in range(1, parts)], 20 * parts)
        cuts = sorted(set(rows.select(asked.alias("q")).first()["q"]))
    # Buckets are numbered from the highest ids down.
    rows = rows.withColumn("bucket", F.lit(len(cuts)) - cuts_below(at, cuts))
    tops = rows.groupBy("bucket").agg(F.max(at).alias("top"))  # a row for each bucket
    w = Window.orderBy("bucket")
    tops = tops.select("bucket", "top", F.lag("bucket").over(w).alias("ahead"), F.max("bucket").over(Window.partitionBy()).alias("last"))
    tops = tops.select("bucket", "top", F.coalesce("ahead", "last").alias("to")).collect()
    ahead = spark.createDataFrame([(r["bucket"], r["top"], r["to"]) for r in tops], "bucket int, top long, to int")
    edges = rows.join(F.broadcast(ahead), "bucket").where(at == F.col("top"))
    # The first row alone ends the bucket ahead: of rows with one id that with the greatest text.
    edges = edges.groupBy(F.col("to").alias("bucket")).agg(F.lit(1).alias("edge"), F.max("doc_id").alias("doc_id"), F.max("text").alias("text"))
    return rows.select("bucket", F.lit(0).alias("edge"), "doc_id", "text").unionByName(edges)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_edits(docs: DataFrame, text_col: str = "text", **band) -> DataFrame:
    """Each document's fingerprint, that of its edited text (its last third replaced by the head of the
    next document, by descending id), and the likeness to both neighbours."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, **band))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.value
        held = None  # the row that waits for its next one

        def told(row: tuple, after: tuple) -> tuple:
            _, doc_id, text, mark = row
            k = len(text) // 3
            edited = text[: len(text) - k] + after[2][:k]
            edited_mark = mark if edited == text else fingerprint(edited, known)
            digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
            return doc_id, len(text), digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, after[3])

        for pdf in frames:
            out = []
            ids = pdf["doc_id"].astype("object").where(pdf["doc_id"].notna(), None)
            for bucket, edge, doc_id, text in zip(pdf["bucket"].tolist(), pdf["edge"].tolist(), ids, pdf["text"].tolist()):
                if held is None and edge:
                    continue  # further rows with the id of the one that closed the bucket
                text = text or ""
                row = (bucket, None if doc_id is None else int(doc_id), text, fingerprint(text, known))
                if held is not None:
                    out.append(told(held, row))
                held = None if edge else row
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    rows = in_descending_order(docs, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    order = F.col("doc_id").cast("long").desc_nulls_last()
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "edge", order, F.col("text").desc_nulls_last())
    return dealt.mapInPandas(compare, RESULT)
