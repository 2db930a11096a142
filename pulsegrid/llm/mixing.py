"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source has a target of words.  Whole epochs come first; what remains of the target is filled in the
order of exponential keys, ``-ln(u) / quality``, until their prefix sum of sizes comes nearest to it.

No sort of a whole source is needed: sizes are summed by ranges of the key, the prefix sum over the
ranges finds the one range in which the target is met, which is cut again until it has few rows, and only
the rows of that range are sorted.  The result is a cut (range and key) for each source, against which
every document is held, so a source with a third of all rows is spread over all tasks.  Tables of one row
for each source go through one task.

A null text has size 0; null is a source of its own and comes last.  Keys hash id and text with a seed,
so reruns agree; rows equal in both are taken or left together.  Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, join_on_key, materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS: Sequence[float] = (5.0, 2.0, 1.0)
#: What the mix takes, as a share of all words, and how often it takes a document at most.
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Ranges of the key at the finest, and how many bits of them each further search tells apart.
RANGE_BITS = 40
STEP_BITS = 10
#: Rows that a range in which a target is met may have before it is cut further.
SORT_ROWS = 1_000_000
#: A table of sources up to this size is broadcast.
BROADCAST_SOURCES = 100_000

#: Names no column of the input is likely to have; they are dropped again.
_SIZE, _KEY, _RANGE, _SOURCE = "__mix_size", "__mix_key", "__mix_range", "__mix_source"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """1 for plain prose, less the more symbols there are for a word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>{}=\\^~]")), F.lit(0))
    return F.lit(1.0) / (1.0 + symbols / F.greatest(size, F.lit(1)))


def _keyed(docs: DataFrame, quality: Column | None, seed: int) -> DataFrame:
    """``docs`` with size, key, range of the key and a source name that is never null."""
    text = F.col("text").cast("string")
    keyed = docs.withColumn(_SIZE, size_of(text))
    weight = quality if quality is not None else quality_of(text, F.col(_SIZE))
    weight = F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(1e-6))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), text)
    u = (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(2.0**53)
    keyed = keyed.withColumn(_KEY, -F.log(u) / weight)
    key = F.col(_KEY)
    return keyed.withColumn(_RANGE, F.floor(F.lit(2.0**RANGE_BITS) * (key / (key + 1))).cast("long")).withColumn(
        _SOURCE, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    )  # so null sorts last


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source name, source_size) with ``target``: shares by weight, none above ``most`` times
    its source's size, the excess reshared by weight.

    In the order of size by weight, the sources that stop are a prefix; the first source that the level
    reached so far does not fill ends it.
    """
    every = Window.partitionBy()
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(_SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    rows = rows.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), _SOURCE)
    full = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("total") - full) / left)
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), F.col("level").alias("level"))))
    rows = rows.withColumn("level", level.over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w")))
    return rows.select(_SOURCE, "source_size", target.alias("target"))


def _inside(slim: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``slim`` in the range (from, to) of their source; the coarse range splits a hot source."""
    coarse = RANGE_BITS - STEP_BITS
    ranges = ranges.withColumn("coarse", F.shiftright("from", coarse))
    rows = slim.withColumn("coarse", F.shiftright(_RANGE, coarse)).join(ranges, [_SOURCE, "coarse"]).drop("coarse")
    return rows.where((F.col(_RANGE) >= F.col("from")) & (F.col(_RANGE) < F.col("to")))


def _met(slim: DataFrame, within: DataFrame, bits: int) -> DataFrame:
    """For each source of ``within`` (source, from, to, room): the range of ``bits`` bits in which ``room`` is met.

    Returns source, from, to, room (what is left of it for the range) and n, the rows of the range.
    """
    shift = RANGE_BITS - bits
    inside = _inside(slim, within.select(_SOURCE, "from", "to")) if "from" in within.columns else slim
    sums = inside.groupBy(_SOURCE, F.shiftright(_RANGE, shift).alias("r")).agg(F.sum(_SIZE).alias("size"), F.count("*").alias("n"))
    upto = F.sum("size").over(Window.partitionBy(_SOURCE).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    met = sums.withColumn("upto", upto).join(within.select(_SOURCE, "room"), _SOURCE)
    met = met.where((F.col("room") > 0) & (F.col("upto") - F.col("size") <= F.col("room")) & (F.col("room") < F.col("upto")))
    at = F.col("r")
    return met.select(
        _SOURCE,
        F.shiftleft(at, shift).alias("from"),
        F.shiftleft(at + 1, shift).alias("to"),
        (F.col("room") - F.col("upto") + F.col("size")).alias("room"),
        "n",
    )


def cuts(slim: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """For each source: n (rows), source_size, target, epochs, and the cut that ends the fractional epoch:
    a range of keys (cut_from, cut_to) and the last key taken in it.  ``slim`` is a written table."""
    sizes = materialise(slim.groupBy(_SOURCE).agg(F.sum(_SIZE).alias("source_size"), F.count("*").alias("n")), "mix-sources")
    sized = targets(sizes, weights, share, most).join(sizes.select(_SOURCE, "n"), _SOURCE)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sized = sized.withColumn("epochs", epochs).withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size"))
    sized = materialise(sized.coalesce(1), "mix-targets")
    met, bits = sized.select(_SOURCE, "room"), 0
    while bits < RANGE_BITS:
        bits = min(RANGE_BITS, bits + STEP_BITS)
        met = materialise(_met(slim, met, bits).coalesce(1), "mix-ranges")
        if (met.agg(F.max("n").alias("n")).first()["n"] or 0) <= SORT_ROWS:
            break
    within = _inside(slim, met.drop("n")).groupBy(_SOURCE, "from", "to", "room", _KEY).agg(F.sum(_SIZE).alias("size"))
    so_far = F.sum("size").over(Window.partitionBy(_SOURCE).orderBy(_KEY).rowsBetween(Window.unboundedPreceding, 0))
    taken = F.when(so_far - F.col("size") / 2 <= F.col("room"), F.col(_KEY))
    ends = within.withColumn("ok", taken).groupBy(_SOURCE, F.col("from").alias("cut_from"), F.col("to").alias("cut_to"))
    return sized.drop("room").join(ends.agg(F.max("ok").alias("cut_key")), _SOURCE, "left")


#: The columns of a cut, named apart from those of the documents that they meet.
_CUT = {c: f"__mix_{c}" for c in ("source_size", "target", "epochs", "cut_from", "cut_to", "cut_key")}


def _taken(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Keyed rows with the columns of their source's cut, and ``__mix_copies``: how often each is taken."""
    sources = found.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    found = found.withColumnsRenamed(_CUT)
    if sources["sources"] <= BROADCAST_SOURCES:
        rows = keyed.join(F.broadcast(found.drop("n")), _SOURCE)
    else:
        rows = join_on_key(keyed, found.withColumnRenamed("n", "__mix_n"), _SOURCE, sources["rows"], "__mix_n")
    at, key = F.col(_RANGE), F.col(_CUT["cut_key"])
    within = (at < F.col(_CUT["cut_from"])) | F.coalesce((at < F.col(_CUT["cut_to"])) & (F.col(_KEY) <= key), F.lit(False))
    copies = F.col(_CUT["epochs"]) + F.coalesce(within, F.lit(False)).cast("long")
    return rows.withColumn("__mix_copies", copies)


def plan_mix(docs: DataFrame, quality: Column | None = None, seed: int = SEED, **shares) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size and key of every document; the cut of every source), both written out."""
    slim = _keyed(docs, quality, seed).select("doc_id", _SOURCE, _SIZE, _KEY, _RANGE)
    slim = materialise(slim, "mix-keys")
    return slim, materialise(cuts(slim, **shares).coalesce(1), "mix-cuts")


def mix_table(docs: DataFrame, quality: Column | None = None, seed: int = SEED, **shares) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken."""
    rows = _taken(*plan_mix(docs, quality, seed, **shares))
    return rows.select(
        "doc_id",
        F.col(_SIZE).alias("size"),
        F.col(_CUT["source_size"]).alias("source_size"),
        F.col(_CUT["target"]).alias("target"),
        (F.col(_SIZE) * F.col("__mix_copies")).alias("taken"),
    )


def mix(docs: DataFrame, quality: Column | None = None, seed: int = SEED, **shares) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns."""
    _, found = plan_mix(docs, quality, seed, **shares)
    rows = _taken(_keyed(docs, quality, seed), found)
    copy = F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies").cast("int")))
    return rows.withColumn("__mix_copy", copy).select(*docs.columns)
