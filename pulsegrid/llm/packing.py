"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents are encoded and cut into pieces of at most ``capacity`` tokens; full pieces are sequences of their own.  The
others are dealt evenly to shards of about ``SHARD_TOKENS``.  A shard is packed by several islands.  An individual is a
set of sequences; a crossover injects the best filled sequences of one parent whole into the other, removes the
sequences that hold a piece twice over, and places the displaced pieces by best fit, largest first.  Islands run in
tasks of their own; after each epoch every island hands its elite to the next one of its shard.  A shard whose elite
has as few sequences as its tokens allow is done.  Each shard then gives up its least filled sequences, which are
packed together on the next level, until one shard is left; so shards cost no more than a sequence in the end.

Pieces of equal length stand in for one another: an individual is a list of lengths by sequence, and rows are given
their places at the end, by their rank among the rows of equal length in their shard.

Null text counts as empty: one piece, which holds only the end token.  Repeated rows and equal or null ids are packed
row by row.  Extra columns play no part; an empty table gives an empty result.  A text is encoded whole, in memory in
proportion to its length; what a worker remembers of other texts is bounded by ``CACHE_ENTRIES``.  The vocabulary is a
file of the tokenizers library that drops white space and marks word ends; its path is a parameter.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, release, small_batches

CAPACITY = 4096
END_ID = 1
#: Tokens of a shard, about, so about a thousand sequences; its islands, their individuals, epochs, crossovers of an epoch.
SHARD_TOKENS = 1000 * CAPACITY
ISLANDS, POPULATION, EPOCHS, CROSSOVERS = 3, 4, 3, 12
#: Share of a parent's sequences that a crossover injects, and least share of its capacity that such a one fills.
INJECTED, WELL_FILLED = 0.4, 0.98
#: Sequences that a shard gives up to the next level: the least filled ones.
GIVEN_UP = 2
#: Chunks of text whose ids a worker remembers.
CACHE_ENTRIES = 700_000
SEED = 29

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
ISLAND = "shard long, island int, elite binary, sequences int, least int, fill double"


# --- encoding

#: Marks between a Latin letter and white space are words of their own, so a gap before them changes nothing; it spares
#: the worker from learning each word with each mark.
_MARKS = re.compile(rb"([.,;:!?#$%&*](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?#$%&*]*)(?=[\x20\n])").sub
#: Words of letters that normal form and lower case leave as they are: the vocabulary's merges are all there is to do.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: The character by which a byte-level vocabulary shows each byte of such words (and of no other).
_SHOWN = {b: 0x100 + 33 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 0x143}
_PROBES = ("a", "the", "quick", "zyx", "abcdefghijklmnopqrstuvwxyz", "ß", "über", "façade", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")


class _Chunks(dict):
    """Ids of chunks, each encoded when it is first asked for."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.encode(chunk)
        return ids


class Encoder:
    """Ids of texts for vocabularies that drop white space: each chunk between gaps is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_merges = not any(_PLAIN(t.strip().encode()) for t in added) and all(
            self._merged(w.encode()) == self._whole(w.encode()) for w in _PROBES
        )
        self.known = _Chunks(self._chunk)

    def _whole(self, chunk: bytes) -> bytes:
        ids = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack("<%dI" % len(ids), *ids)

    def _merged(self, chunk: bytes) -> bytes:
        ids = [t.id for t in self.merge(chunk.decode("latin-1").translate(_SHOWN))]
        return struct.pack("<%dI" % len(ids), *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        return self._merged(chunk) if self.by_merges and _PLAIN(chunk) else self._whole(chunk)

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        known = self.known
        for t in texts:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            # special strings are matched before lower-casing
            chunks = (t if b"<|" in t else _MARKS(rb" \1", t.lower())).split()
            yield b"".join(map(known.__getitem__, chunks))


_encoders: dict[str, Encoder] = {}
#: Bytes of text that are encoded together.
STEP_BYTES = 1 << 22


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and deal, a number that spreads the rows evenly."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, None) or Encoder(path)
        _encoders[path] = encoder
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            at = 0
            while at < len(texts):
                step: list[bytes] = []
                size = 0
                while at + len(step) < len(texts) and (not step or size < STEP_BYTES):
                    step.append(texts[at + len(step)].as_py() or b"")
                    size += len(step[-1])
                for k, raw in enumerate(encoder.encode(step)):
                    raw += end
                    for piece, a in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[a : a + 4 * capacity]
                        rows.append((doc_ids[at + k], piece, a // 4, len(part) // 4, zlib.crc32(part)))
                at += len(step)
            columns = list(zip(*rows)) if rows else [[]] * 5
            deal = rng.integers(0, 1 << 62, len(rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)] + [pa.array(deal, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, PIECES)


# --- one shard


class Bins:
    """Sequences under construction; finds the one that a piece fits best by the bits of free space in use."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free = capacity, [], [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, bin_: list[int]) -> None:
        self._put(len(self.bins), self.capacity - sum(bin_))
        self.bins.append(bin_)

    def _put(self, number: int, space: int) -> None:
        if not self.free[space]:
            self.mask |= 1 << space
        self.free[space].append(number)

    def best_fit(self, size: int) -> None:
        above = self.mask >> size
        if not above:
            self.add([size])
            return
        space = size + (above & -above).bit_length() - 1
        stack = self.free[space]
        number = stack.pop()
        if not stack:
            self.mask ^= 1 << space
        self.bins[number].append(size)
        self._put(number, space - size)


def fitness(bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones: the mean square of what is filled."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def packed(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Pieces by best fit, in this order."""
    bins = Bins(capacity)
    for x in lengths:
        bins.best_fit(x)
    return bins.bins


def crossover(giver: list[list[int]], taker: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled sequences of ``giver`` in ``taker``: what they hold leaves it, and the rest is best-fitted."""
    full = [k for k, b in enumerate(giver) if sum(b) >= WELL_FILLED * capacity]
    n = max(1, round(INJECTED * rng.random() * len(full)))
    chosen = [giver[k] for k in rng.permutation(full)[:n].tolist()]
    twice = Counter(x for b in chosen for x in b)
    child, displaced = Bins(capacity), []
    for k in rng.permutation(len(taker)).tolist():
        hit = [x for x in taker[k] if twice[x] > 0]
        if not hit:
            child.add(list(taker[k]))
            continue
        rest = []
        for x in taker[k]:
            if twice[x] > 0:
                twice[x] -= 1
            else:
                rest.append(x)
        displaced += rest
    for b in chosen:
        child.add(list(b))
    # the least filled sequences are emptied too: their pieces get another chance
    poor = sorted(range(len(child.bins)), key=lambda k: sum(child.bins[k]))[: max(1, len(child.bins) // 50)]
    displaced += [x for k in poor for x in child.bins[k]]
    gone = set(poor)
    again = Bins(capacity)
    for k, b in enumerate(child.bins):
        if k not in gone:
            again.add(b)
    for x in sorted(displaced, reverse=True):
        again.best_fit(x)
    return again.bins


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and one for each piece over half of one."""
    return max(-(-sum(lengths) // capacity), sum(2 * x > capacity for x in lengths))


def to_bytes(bins: list[list[int]]) -> bytes:
    """Lengths by sequence, each sequence ended by 0."""
    return np.array([x for b in bins for x in (*b, 0)], "<u2").tobytes()


def from_bytes(raw: bytes) -> list[list[int]]:
    flat = np.frombuffer(raw, "<u2")
    return [b[b > 0].tolist() for b in np.split(flat, np.flatnonzero(flat == 0))[:-1]] if len(flat) else []


def disordered(lengths: Sequence[int], rng: np.random.Generator) -> list[int]:
    """Largest first, but for some disorder."""
    array = np.array(lengths, np.int64)
    return array[np.argsort(-array * rng.uniform(0.8, 1.25, len(array)))].tolist()


def evolve(seeds: list[list[list[int]]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """The best individual after an epoch, from these and best-fit ones in other orders."""
    best = max(seeds, key=lambda b: fitness(b, capacity))
    least = lower_bound(lengths, capacity)
    people = list(seeds)
    while len(people) < POPULATION and len(best) > least:
        people.append(packed(disordered(lengths, rng), capacity))
        best = max(people, key=lambda b: fitness(b, capacity))
    for _ in range(CROSSOVERS):
        if len(best) <= least:
            break
        giver, taker = rng.choice(len(people), 2, replace=False).tolist()
        people.append(crossover(people[giver], people[taker], capacity, rng))
        people.sort(key=lambda b: fitness(b, capacity), reverse=True)
        people = people[:POPULATION]
        best = people[0]
    return best


# --- all shards


def _epoch(islands: DataFrame, turn: int, capacity: int) -> DataFrame:
    """Islands (shard, island, lengths or elites) after an epoch; those of a shard that is done stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng([SEED, turn, row["shard"], row["island"]])
                if turn == 0:
                    lengths = np.frombuffer(row["lengths"], "<u2").tolist()
                    first = sorted(lengths, reverse=True) if row["island"] == 0 else disordered(lengths, rng)
                    seeds = [packed(first, capacity)]
                else:
                    seeds = [from_bytes(row["elite"]), from_bytes(row["arrived"])]
                    lengths = sorted(x for b in seeds[0] for x in b)
                best = evolve(seeds, lengths, capacity, rng)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": row["island"], "elite": to_bytes(best), "sequences": len(best), "least": lower_bound(lengths, capacity), "fill": fitness(best, capacity)[1]}],
                    schema=pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("elite", pa.binary()), ("sequences", pa.int32()), ("least", pa.int32()), ("fill", pa.float64())]),
                )

    return islands.mapInArrow(run, ISLAND)


#: Islands of a task, about, and tasks over which the islands of a level are dealt at most.
TASK_ISLANDS, ISLAND_TASKS = 8, 10_000


def _spread(rows: DataFrame, shards: int, islands: int) -> DataFrame:
    """A task for a few islands each: their work is long for their size."""
    return rows.repartition(min(ISLAND_TASKS, -(-shards * islands // TASK_ISLANDS)), "shard", "island")


def pack_shards(lengths: DataFrame, shards: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(shard, elite) for rows (shard, length) of about that many shards."""
    grouped = lengths.groupBy("shard").agg(F.sort_array(F.collect_list("length")).alias("l"))  # of about SHARD_TOKENS together
    raw = F.unhex(F.array_join(F.transform("l", lambda x: F.lpad(F.hex(x % 256 * 256 + F.shiftright(x, 8)), 4, "0")), ""))
    start = grouped.select("shard", raw.alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = materialise(_epoch(_spread(start, shards, islands), 0, capacity), "islands")
    ring = Window.partitionBy("shard").orderBy("island")
    best = Window.partitionBy("shard").orderBy("sequences", F.col("fill").desc(), "island")
    done: list[DataFrame] = []
    of = Window.partitionBy("shard")
    for turn in range(1, epochs):
        over = state.withColumn("over", F.min(F.col("sequences") - F.col("least")).over(of))
        done.append(over.where("over = 0").drop("over"))
        first = F.first("elite").over(ring)
        moved = over.where("over > 0").withColumn("arrived", F.coalesce(F.lead("elite").over(ring), first)).drop("over")
        if moved.isEmpty():
            state = state.limit(0)
            break
        state = materialise(_epoch(_spread(moved, shards, islands), turn, capacity), "islands")
    state = reduce(DataFrame.unionByName, done, state)
    return state.withColumn("k", F.row_number().over(best)).where("k = 1").select("shard", "elite")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, bin (the least filled first), offset, length, rank (among those of the length)."""
    for batch in batches:
        for shard, elite in zip(*(c.to_pylist() for c in batch.columns)):
            bins = sorted(from_bytes(elite), key=sum)
            counts = np.array([len(b) for b in bins])
            flat = np.array([x for b in bins for x in b], np.int64)
            begins = np.cumsum(counts) - counts
            before = np.cumsum(flat) - flat
            offset = before - np.repeat(before[begins], counts)
            order = np.argsort(flat, kind="stable")
            ordered = flat[order]
            starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)) if len(flat) else np.zeros(0, np.int64)
            rank = np.empty(len(flat), np.int64)
            rank[order] = np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))
            columns = {
                "shard": pa.array(np.full(len(flat), shard), pa.int64()), "bin": pa.array(np.repeat(np.arange(len(bins)), counts), pa.int64()),
                "offset": pa.array(offset, pa.int64()), "length": pa.array(flat, pa.int64()), "rank": pa.array(rank + 1, pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns)


def _tokens(pieces: DataFrame) -> int:
    return pieces.agg(F.sum("length")).first()[0] or 0


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``pieces`` (with length and deal) with sequence_id and offset; deal is dropped.

    Sequence ids: the level in the lowest bits, then shard and number in it.
    """
    columns = [c for c in pieces.columns if c != "deal"]
    full = pieces.where(F.col("length") >= capacity).select(*columns, F.col("deal"))
    rest = pieces.where(F.col("length") < capacity)
    # a full piece is numbered by where it lies; the table it lies in is written
    placed = [full.select(*columns, (F.monotonically_increasing_id() * 16 + 15).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    tokens, level = _tokens(rest), 0
    while tokens:
        shards = max(1, round(tokens / shard_tokens))
        dealt = materialise(rest.withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)).cast("long")), "dealt")
        slots = pack_shards(dealt.select("shard", F.col("length").cast("int").alias("length")), shards, capacity).mapInArrow(
            _slots, "shard long, bin long, offset long, length long, rank long"
        )
        rank = F.row_number().over(Window.partitionBy("shard", "length").orderBy("deal", "doc_id", "piece", "ids_crc32"))
        found = dealt.withColumn("rank", rank.cast("long")).join(slots, ["shard", "length", "rank"])
        last = shards == 1 or level == 14
        found = materialise(found, "placed")
        release(dealt)
        kept = found if last else found.where(F.col("bin") >= GIVEN_UP)
        number = (F.shiftleft("bin", 28).bitwiseOR(F.col("shard"))) * 16 + level
        placed.append(kept.select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        rest = found.where(F.col("bin") < GIVEN_UP).select(*pieces.columns)
        tokens, level = _tokens(rest), level + 1
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(materialise(cut_pieces(docs, path, capacity), "pieces"), capacity, shard_tokens)
