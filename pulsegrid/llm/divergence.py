"""Source divergence audit: how far the term probabilities of each source lie from those of others of its language.

Terms are counted in one pass over the texts, summed in each task before they are shuffled.  A language keeps the
terms that enough of its documents have; a group is a source in a language.  Probabilities are smoothed and are
whole billionths, ``p = 1 + floor(1e9 * (count + 5) / (N + 5 V))``.

*Terms that a group over-uses* are found by upper bounds.  The group's terms fall into buckets by count; no term of a
bucket can exceed the largest group probability less the smallest probability that the language gives to a term of
that bucket.  Buckets are evaluated best bound first, and a group is done once the bounds of all its unseen buckets
are strictly below its k-th best value; so most buckets (the many rare terms) are never joined with their terms.

*Pairs of sources* are summed from postings, the sources of each term.  A term that only one of two sources has
adds what the smoothing says, so it is enough to visit the terms that both have:

    sum |p - q| = H(a, b) + H(b, a) + |a0 - b0| (V - |A| - |B|) + sum over shared terms of
                  |p - q| - |p - b0| - |a0 - q| + |a0 - b0|

where ``a0`` is the probability of a term that ``a`` lacks and ``H(a, b)`` the sum of |p - b0| over the terms of
``a``, which running sums over the distinct values of ``p`` give.  Shared terms are added up in matrices of two
blocks of about ``BLOCK`` sources in each task; no row is made for a pair of postings.

Null text, language and source count as empty.  Repeated rows count each; ids play no part, nor do extra columns.  An
empty table gives an empty result, a language without kept terms only pairs of value 0.  A very long text is counted
in pieces of ``STEP_BYTES``, cut between terms.  Counts are exact up to 9e15 occurrences in a group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, release, small_batches

MIN_DOCS = 30
TOP = 50
SMOOTHING = 5
#: Distinct terms that a task holds before it hands their sums on, and bytes of a text that are split at once.
HELD_TERMS = 400_000
STEP_BYTES = 1 << 23
#: Sources of a block, about, and matrices that a task holds.
BLOCK = 64
HELD_MATRICES = 128
#: Groups up to this many are broadcast, after a count; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Buckets for each doubling of the count, above ``EXACT`` counts that have a bucket each.
EXACT, PER_DOUBLING = 64, 16

_UPPER, _LOWER = range(0x41, 0x5B), range(0x61, 0x7B)
#: Terms are runs of ASCII letters and bytes from 0x80 on; A-Z are lower-cased, all other bytes separate.
_TABLE = bytes(b + 32 if b in _UPPER else b if b in _LOWER or b >= 0x80 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + STEP_BYTES].translate(_TABLE)
        if at + STEP_BYTES < len(text) and 32 in piece:  # the last term may go on
            piece = piece[: piece.rindex(b" ") + 1]
        elif at + STEP_BYTES < len(text):  # one term longer than a piece
            rest = text[at:].translate(_TABLE)
            piece = rest[: rest.index(b" ") + 1] if b" " in rest else rest
        at += len(piece)
        yield piece.split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) sums of a task; each group has an empty term with 0."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (found, docs) in groups.items():
            n = len(found)
            columns = {
                "lang": pa.array([lang] * (n + 1), pa.string()), "source": pa.array([source] * (n + 1), pa.string()),
                "term": pa.array([b"", *found], pa.binary()).cast(pa.string()),
                "n": pa.array([0, *found.values()], pa.int64()), "docs": pa.array([0, *map(docs.__getitem__, found)], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*batch.columns):
            found, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            own: set[bytes] = set()
            held -= len(found)
            for part in terms(text.as_py()):
                found.update(part)
                own.update(part)
            docs.update(own)
            held += len(found)
            if held > HELD_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it); the empty term stands for the group itself."""
    small_batches(docs.sparkSession)
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*names[:2], names[2].cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(count: Column, total: Column) -> Column:
    """``1 + floor(1e9 * (count + 5) / total)`` by long division in steps of a thousand, exact in longs."""
    rest = count + F.lit(SMOOTHING).cast("long")
    whole = _div(rest, total)
    for _ in range(3):
        rest = rest % total * 1000
        whole = whole * 1000 + _div(rest, total)
    return whole + 1


def kept_postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, n_lang and postings (source, n) of the terms that each language keeps.

    The empty term of a language lists all its sources.
    """
    by_term = count_terms(docs).groupBy("lang", "term").agg(
        F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings")
    )
    return by_term.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs")


def group_table(kept: DataFrame) -> DataFrame:
    """A row for each group: its number (``id``: block and place), how many kept terms it has, the totals of its
    probabilities and of its language's (null without kept terms), p0 (of a term it lacks), n_blocks."""
    real = kept.where("term <> ''")
    entries = real.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.source")
    own = entries.agg(F.sum("x.n").alias("own_n"), F.count("*").alias("n_terms"))
    sources = kept.where("term = ''").select("lang", F.explode("postings.source").alias("source"))
    spread = kept.where("term = ''").select("lang", F.ceil(F.size("postings") / F.lit(BLOCK)).cast("int").alias("n_blocks"))
    langs = real.groupBy("lang").agg(F.sum("n_lang").alias("all_n"), F.count("*").alias("v"))
    rows = sources.join(own, ["lang", "source"], "left").join(spread.join(langs, "lang", "left"), "lang")
    block = F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("long")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1
    smooth = SMOOTHING * F.col("v")
    total = F.coalesce(F.col("own_n"), F.lit(0)) + smooth
    return rows.withColumn("block", block).select(
        "lang", "source", "n_blocks", "block", F.shiftleft("block", 24).bitwiseOR(place.cast("long")).alias("id"), "v",
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"), total.alias("total"), (F.col("all_n") + smooth).alias("lang_total"),
        F.when(F.col("v").isNotNull(), probability(F.lit(0).cast("long"), total)).alias("p0"),
    )


def bucket_of(count: Column) -> Column:
    """Buckets of counts: each small one, then ``PER_DOUBLING`` for each doubling."""
    return F.when(count <= EXACT, count).otherwise(EXACT + F.floor(F.log2(count / EXACT) * PER_DOUBLING)).cast("int")


def entries_of(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each kept term of each group that has it: lang, source, id, p0, term, bucket, p and q (the language's)."""
    rows = kept.where("term <> ''").select("lang", "term", "n_lang", F.explode("postings").alias("x")).select("lang", "term", "n_lang", "x.*")
    facts = groups.select("lang", "source", "id", "p0", "total", "lang_total")
    few = groups.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(facts) if few else facts, ["lang", "source"]).select(
        "lang", "source", "id", "p0", "term", bucket_of(F.col("n")).alias("bucket"),
        probability(F.col("n"), F.col("total")).alias("p"), probability(F.col("n_lang"), F.col("lang_total")).alias("q"),
    )


# --- terms by upper bounds


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    return found.select("lang", "source", "term", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def overused_terms(entries: DataFrame, top: int = TOP, log: list[int] | None = None) -> DataFrame:
    """The ``top`` terms of each group by p - q > 0: lang, source, term, value, rank.

    ``log`` gets the number of buckets evaluated in each round.
    """
    group = ["lang", "source"]
    bounds = entries.groupBy(*group, "bucket").agg(F.count("*").alias("n"), (F.max("p") - F.min("q")).alias("bound")).where("bound > 0")
    best = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket")
    ahead = F.coalesce(F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unseen = materialise(bounds.withColumn("ahead", ahead), "bounds")
    found, reach = None, top
    while True:
        if found is None:
            open_ = F.col("ahead") < reach
            asked = unseen.withColumn("kth", F.lit(None).cast("long"))
        else:
            kth = found.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
            asked = unseen.join(kth, group, "left")
            open_ = F.when(F.col("kth").isNull(), F.col("ahead") < reach).otherwise(F.col("bound") >= F.col("kth"))
        asked = materialise(asked.withColumn("open", open_), "asked")
        chosen = asked.where("open").select(*group, "bucket")
        n_open = chosen.count()
        if log is not None:
            log.append(n_open)
        if n_open:
            fresh = entries.join(chosen, [*group, "bucket"]).where("p > q").select(*group, "term", (F.col("p") - F.col("q")).alias("value"))
            both = fresh if found is None else found.drop("rank").unionByName(fresh)
            after = materialise(_ranked(both, top), "found")
            if found is not None:
                release(found)
            found = after
        elif found is None:
            return _ranked(entries.select(*group, "term", F.col("p").alias("value")).limit(0), top)
        # a group without its k-th value goes on; one that has it opens no bucket twice
        left = asked.where(~F.col("open") & (F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))).drop("open", "kth")
        if left.isEmpty():
            return found
        unseen = left
        reach *= 8


# --- pairs by postings


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, x, y, part: what the terms that both groups have add to their pair, summed in the task."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), m in held.items():
            i, j = np.nonzero(m)
            x, y = (a << 24) | i, (b << 24) | j
            columns = {"lang": pa.array([lang] * len(i), pa.string()), "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64()), "part": pa.array(m[i, j], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)
        held.clear()

    def dense(rows: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        values, has, base = np.zeros((n, place.max() + 1), np.int64), np.zeros((n, place.max() + 1), bool), np.zeros(place.max() + 1, np.int64)
        values[rows, place], has[rows, place], base[place] = p, True, p0
        return values, has, base

    for batch in batches:
        langs, posts = batch.column(0).to_pylist(), batch.column(1)
        term = np.repeat(np.arange(len(posts)), np.diff(posts.offsets.to_numpy()))
        flat = posts.flatten()
        ids, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        lang_of = np.array(langs, object)
        for lang in set(langs):
            mine = np.flatnonzero((lang_of == lang)[term])
            names, rows = np.unique(term[mine], return_inverse=True)
            block, place = ids[mine] >> 24, ids[mine] & 0xFFFFFF
            blocks = {}
            for b in np.unique(block).tolist():
                at = np.flatnonzero(block == b)
                blocks[b] = dense(rows[at], place[at], p[mine[at]], p0[mine[at]], len(names))
            for a in blocks:
                for b in blocks:
                    if a > b:
                        continue
                    (pa_, ma, a0), (pb, mb, b0) = blocks[a], blocks[b]
                    add = np.zeros((len(a0), len(b0)), np.int64)
                    for i in range(len(a0)):
                        r = np.flatnonzero(ma[:, i])
                        if len(r):
                            x, y = pa_[r, i][:, None], pb[r]
                            both = np.abs(x - y) - np.abs(x - b0) - np.abs(a0[i] - y) + np.abs(a0[i] - b0)
                            add[i] = (both * mb[r]).sum(0)
                    old = held.get((lang, a, b))
                    if old is not None:
                        shape = np.maximum(old.shape, add.shape)
                        total = np.zeros(shape, np.int64)
                        total[: old.shape[0], : old.shape[1]] += old
                        total[: add.shape[0], : add.shape[1]] += add
                        add = total
                    held[(lang, a, b)] = add
                    if len(held) > HELD_MATRICES:
                        yield from flush()
    yield from flush()


def source_pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed difference of each group and each other source of its language."""
    posts = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0")).alias("posts")).select("lang", "posts")
    shared = posts.mapInArrow(_shared, "lang string, x long, y long, part long").where("x < y")
    own = groups.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks").cast("long") - 1)))
    left = own.select("lang", F.col("block").alias("ba"), F.col("other").alias("bb"), *[F.col(c).alias(f"x_{c}") for c in ("source", "id", "p0", "n_terms", "v")])
    right = own.select("lang", F.col("other").alias("ba"), F.col("block").alias("bb"), *[F.col(c).alias(f"y_{c}") for c in ("source", "id", "p0", "n_terms")])
    pairs = left.join(right, ["lang", "ba", "bb"]).where("x_id <> y_id")  # each ordered pair, in blocks
    # H(x, y): running sums over the distinct values of x, read off at y's p0
    values = entries.groupBy("lang", "id", "p").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("long")
    events = values.select("lang", F.col("id").alias("x"), none.alias("y"), "p", "n").unionByName(
        pairs.where("x_v IS NOT NULL").select("lang", F.col("x_id").alias("x"), F.col("y_id").alias("y"), F.col("y_p0").alias("p"), F.lit(0).cast("long").alias("n"))
    )
    of = Window.partitionBy("lang", "x")
    sums = {"n_all": F.sum("n").over(of), "s_all": F.sum(F.col("n") * F.col("p")).over(of)}
    run = of.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums |= {"n_low": F.sum("n").over(run), "s_low": F.sum(F.col("n") * F.col("p")).over(run)}
    h = F.expr("p * n_low - s_low + (s_all - s_low) - p * (n_all - n_low)")
    alone = events.withColumns(sums).where("y IS NOT NULL").select(
        "lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), h.alias("part")
    )
    base = pairs.where("x_id < y_id").select(
        "lang", F.col("x_id").alias("x"), F.col("y_id").alias("y"),
        F.coalesce(F.abs(F.col("x_p0") - F.col("y_p0")) * (F.col("x_v") - F.col("x_n_terms") - F.col("y_n_terms")), F.lit(0)).alias("part"),
        F.col("x_source").alias("a"), F.col("y_source").alias("b"),
    )
    unnamed = [F.lit(None).cast("string").alias(c) for c in "ab"]
    parts = base.unionByName(alone.select("*", *unnamed)).unionByName(shared.select("*", *unnamed))
    summed = parts.groupBy("lang", "x", "y").agg(F.sum("part").alias("value"), F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return summed.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources of a language, and the terms each group over-uses."""
    kept = materialise(kept_postings(docs, min_docs), "kept")
    groups = materialise(group_table(kept), "groups")
    entries = materialise(entries_of(kept, groups), "entries")
    release(kept)
    pairs = source_pairs(entries, groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    terms_ = overused_terms(entries, top).withColumnRenamed("term", "item")
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms_.withColumn("part", F.lit("term")).select(*columns))
