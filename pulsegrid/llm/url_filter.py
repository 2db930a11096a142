"""URL filters: a blocked Bloom filter in front of an exact hash join.

Rules name a host and the start of a path; a rule fits its host and all subdomains.  A url has one
candidate key for each suffix of its host and each length that a rule's path has.  Candidates that a
blocked Bloom filter over the canonical rule keys does not pass are dropped where they arise; the
rest meet the rules in an exact join, which removes false positives, and the longest match wins.
Urls that no rule fits get the verdict of a second, plain list of canonical urls (filtered and joined
in the same way), and ``default`` when that does not name them either.

A null url, or one without ``://``, has an empty host and path and no candidates.  Repeated pages keep
one row each.  Null ids are kept.  Of equal rules with different verdicts the blocking one wins.  An empty table of
pages gives no row, and empty lists fit nothing.  Extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import lower_ascii

#: Bits of a block, which one cache line holds, and bits that a key sets in its block.
BLOCK_BITS = 512
PROBES = 6
BITS_PER_KEY = 12
WORDS = BLOCK_BITS // 64
_ODD = np.random.default_rng(2).integers(1, 1 << 63, PROBES, dtype=np.uint64) | np.uint64(1)
#: Bounds of the filter: a larger list makes it pass more candidates, which the join then removes.
MAX_BLOCKS = 1 << 20
#: A list up to this many rows is broadcast for the join; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first ``://`` and ``/ ? #``, A-Z lower-cased; then up to ``? #``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def canonical_url(url: Column) -> Column:
    """Host and path without a leading ``www.`` and a trailing slash."""
    host, path = split_url(url)
    return F.regexp_replace(F.concat(F.regexp_replace(host, r"^www\.", ""), path), "/$", "")


def host_suffixes(host: Column) -> Column:
    """``a.b.c``, ``b.c`` and ``c``; none of an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    return F.when(host != "", tails).otherwise(F.array().cast("array<string>"))


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each 64-bit hash, and for each probe the word of the block and the bit to set."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    bit = (h[:, None] * _ODD[None, :]) >> np.uint64(64 - 9)  # 9 bits name one of 512
    return block, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


class BlockedBloom:
    """Blocks of 512 bits; a key has one block and sets ``PROBES`` bits in it."""

    def __init__(self, keys: DataFrame):
        """``keys``: a column ``key``.  The executors set the bits; the driver gets the words of the
        blocks that have any, at most ``MAX_BLOCKS`` blocks of 64 bytes."""
        n = keys.count()  # of any keys, those that repeat too
        self.blocks = blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // BLOCK_BITS)))

        def set_bits(frames):
            for pdf in frames:
                block, word, bits = places(pdf["h"].to_numpy(np.int64), blocks)
                at = (block[:, None] * WORDS + word).ravel()
                yield pd.DataFrame({"word": at, "bits": bits.ravel().view(np.int64)})

        words = keys.select(F.xxhash64("key").alias("h")).mapInPandas(set_bits, "word long, bits long")
        self.words = np.zeros(blocks * WORDS, np.uint64)
        for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            self.words[r["word"]] = np.int64(r["bits"]).view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(self.words)

    def passing(self, keys: Column) -> Column:
        """The elements of an array of keys that the filter passes."""
        blocks, shared = self.blocks, self.shared

        @F.pandas_udf("array<boolean>")
        def might_hold(hashes: pd.Series) -> pd.Series:
            sizes = [len(x) for x in hashes]
            flat = np.concatenate([np.zeros(0, np.int64), *hashes]).astype(np.int64)
            block, word, bits = places(flat, blocks)
            good = (shared.value[block[:, None] * WORDS + word] & bits != 0).all(axis=1)
            return pd.Series(np.split(good, np.cumsum(sizes)[:-1])) if sizes else pd.Series([], dtype=object)

        held = might_hold(F.transform(keys, lambda k: F.xxhash64(k)))
        pairs = F.filter(F.arrays_zip(keys.alias("key"), held.alias("held")), lambda x: x["held"])
        return F.transform(pairs, lambda x: x["key"])


def _exact_join(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """Left join on ``key``; the list is broadcast only when it is known to be small."""
    if listed.count() <= BROADCAST_ROWS:
        return candidates.join(F.broadcast(listed), "key", "left")
    salts = 16  # one url may fill a third of the pages
    listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = candidates.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return dealt.join(listed, ["key", "salt"], "left").drop("salt")


def url_filter(
    pages: DataFrame,
    rules: DataFrame,
    blocked_urls: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict.  ``blocked_urls``: url.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.concat(F.lit("\n"), canonical_url(F.col("url"))).alias("plain"),
    )
    rules = rules.where(F.col("host").isNotNull()).select(
        lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
    )
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("ruled"))  # block comes after allow
    lists = rules.select(
        F.concat("rule_host", F.lit("\n"), "rule_path").alias("key"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "ruled",
        (F.length("rule_host") + F.length("rule_path")).alias("rank"),
    )
    if blocked_urls is not None:  # a plain url ranks below any rule
        plain = blocked_urls.select(F.concat(F.lit("\n"), canonical_url(F.col("url"))).alias("key"))
        plain = plain.where(F.length("key") > 1).distinct()
        lists = lists.unionByName(
            plain.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("ruled"), F.lit(-1).alias("rank"))
        )
    bloom = BlockedBloom(lists.select("key"))
    # The lengths of the rules' paths: no more than a url can have characters.
    length = F.length("rule_path").alias("n")
    lengths = F.array(*[F.lit(r["n"]) for r in rules.select(length).distinct().orderBy("n").collect()]).cast("array<int>")
    starts = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    ruled = F.transform(
        host_suffixes(F.col("host")), lambda h: F.transform(starts, lambda p: F.concat(h, F.lit("\n"), p))
    )
    keys = F.when(F.col("host") != "", F.concat(F.flatten(ruled), F.array("plain"))).otherwise(F.array().cast("array<string>"))
    hits = rows.withColumn("keys", keys).withColumn("hit", F.explode_outer(bloom.passing(F.col("keys"))))
    # A row without a hit gets a key of its own, so that a shuffled join does not send them all to one task.
    hits = hits.select("row", "page_id", "host", "path", F.coalesce("hit", F.concat(F.lit("\n\n"), F.col("row"))).alias("key"))
    best = _exact_join(hits, lists).groupBy("row", "page_id", "host", "path")
    best = best.agg(F.max_by(F.struct("rule", "ruled"), "rank").alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.ruled", F.lit(default)).alias("verdict")
    )
