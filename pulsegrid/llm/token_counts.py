"""Token counts by counting pieces once per distinct pre-token.

Documents are split into pre-tokens and their frequencies counted, in batches: a batch has one row
for each distinct pre-token, with the documents it occurs in and how often.  These rows are dealt and
sorted by pre-token, so that each distinct one is encoded once where its rows meet, and its number of
pieces is joined to them there; the products are summed for each document.  So that no pre-token's rows
outgrow a task, those of ``RARE_PARTS`` input partitions meet, of ``HOT_PARTS`` if a large share of a batch's
documents has it, and it is encoded once in each such part.  No list of ids is ever built for a document.

Null text counts as empty and has no token.  Repeated rows and equal or null ids are counted row by
row.  Extra columns play no part.  An empty table gives an empty one.  A long text is split whole, in
memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import Numbering, vocabulary

#: Bounds of a batch: documents (they are numbered in 16 bits) and characters of text.
BATCH_DOCS = 16_384
BATCH_CHARS = 1 << 24
#: Sums that a task holds, at most about twice, before it hands them on.
HELD_SUMS = 1 << 21
#: Rows of pre-tokens, or bytes, that a task takes at once: many distinct ones are encoded together.
WAITING_ROWS = 200_000
WAITING_BYTES = 1 << 25
#: A pre-token in more than this share of a batch's documents is hot there.
HOT_SHARE = 0.1
#: Input partitions whose rows of one pre-token go to the same task.
HOT_PARTS = 4
RARE_PARTS = 1024

#: ``token`` is null in the one row of a batch that names its documents: their ids and bytes, packed.
ROWS = "batch long, part int, token string, posts binary"
SUMS = "batch long, named boolean, posts binary"
_NO_ID = -(2**63)


def pack_names(ids: list, n_bytes: list[int]) -> bytes:
    """The ids (null apart) and bytes of a batch's documents."""
    null = np.array([i is None for i in ids], np.uint8)
    known = np.array([_NO_ID if i is None else int(i) for i in ids], "<i8")
    return null.tobytes() + known.tobytes() + np.array(n_bytes, "<i8").tobytes()


def unpack_names(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(null, ids, bytes) of a batch's documents."""
    n = len(packed) // 17
    return np.frombuffer(packed, "u1", n).astype(bool), np.frombuffer(packed, "<i8", n, n), np.frombuffer(packed, "<i8", n, 9 * n)


def pack(docs: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents of a pre-token and its frequency in each: the width of a frequency, then both lists."""
    narrow = counts.max() < 256
    return bytes([1 if narrow else 4]) + docs.astype("<u2").tobytes() + counts.astype("u1" if narrow else "<u4").tobytes()


def unpack(posts: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = posts[0]
    n = (len(posts) - 1) // (2 + width)
    return np.frombuffer(posts, "<u2", n, 1), np.frombuffer(posts, "u1" if width == 1 else "<u4", n, 1 + 2 * n)


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for pdf in frames:
        for i, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
            ids.append(i)
            texts.append(text or "")
            size += len(texts[-1])
            if len(ids) == BATCH_DOCS or size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """For each batch: a row for each distinct pre-token, and one that names its documents."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path).words
        at = TaskContext.get().partitionId()
        batch = at << 24
        for ids, texts in _batches(frames):
            n = len(ids)
            number = Numbering()
            of = [np.fromiter(map(number.__getitem__, words(t)), np.int32) for t in texts]
            doc = np.repeat(np.arange(n), [len(x) for x in of])
            keys, counts = np.unique(np.concatenate(of).astype(np.int64) * n + doc, return_counts=True)
            token, doc = np.divmod(keys, n)
            cuts = np.searchsorted(token, np.arange(len(number) + 1)).tolist()
            n_bytes = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pd.DataFrame({"batch": [batch], "part": 0, "token": [None], "posts": [pack_names(ids, n_bytes)]})
            tokens = list(number)
            for a in range(0, len(tokens), 50_000):
                some = range(a, min(a + 50_000, len(tokens)))
                posts = [pack(doc[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in some]
                hot = np.diff(cuts[a : a + len(some) + 1]) > max(16, HOT_SHARE * n)
                part = np.where(hot, 1 + at // HOT_PARTS, -1 - at // RARE_PARTS)
                yield pd.DataFrame({"batch": batch, "part": part, "token": tokens[a : a + 50_000], "posts": posts})
            batch += 1

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(split, ROWS)


def products(batch: np.ndarray, pieces: np.ndarray, posts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, pieces * frequency) of all posts, those of one length together; a key is batch and document."""
    lengths = np.fromiter(map(len, posts), np.int64, len(posts))
    order = np.argsort(lengths, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(lengths[order])) + 1).tolist(), len(order)]
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(cuts, cuts[1:]):
        rows = order[a:b]
        size = int(lengths[order[a]]) if b > a else 0
        table = np.frombuffer(b"".join([posts[k] for k in rows.tolist()]), np.uint8).reshape(-1, max(1, size))
        for width in (1, 4):
            of = np.flatnonzero(table[:, 0] == width)
            if len(of):
                n = (size - 1) // (2 + width)
                docs = np.ascontiguousarray(table[of, 1 : 1 + 2 * n]).view("<u2").astype(np.int64)
                counts = np.ascontiguousarray(table[of, 1 + 2 * n :]).view("u1" if width == 1 else "<u4").astype(np.int64)
                keys.append(((batch[rows[of], None] << 14) + docs).ravel())
                sums.append((counts * pieces[rows[of], None]).ravel())
    return np.concatenate(keys), np.concatenate(sums)


def by_key(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the total of each."""
    key, value = np.concatenate(keys), np.concatenate(sums)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(value[order], first) if len(first) else value


class _Held:
    """Sums of documents, added up whenever many have come."""

    def __init__(self) -> None:
        self.keys = [np.zeros(0, np.int64)]
        self.sums = [np.zeros(0, np.int64)]
        self.n = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.n += len(keys)
        if self.n > HELD_SUMS:
            self.compact()

    def compact(self) -> None:
        key, value = by_key(self.keys, self.sums)
        self.keys, self.sums, self.n = [key], [value], len(key)

    def told(self) -> pd.DataFrame:
        """A row or two for each batch, and nothing is held any more."""
        self.compact()
        key, value = self.keys[0], self.sums[0]
        batches, posts = [], []
        batch = key >> 14
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(key)] if len(key) else [0]
        for a, b in zip(cuts, cuts[1:]):
            docs, own = key[a:b] & 16_383, value[a:b]
            for some in (own < 256, own >= 256):  # few sums are wide
                if some.any():
                    batches.append(int(batch[a]))
                    posts.append(pack(docs[some], own[some]))
        self.__init__()
        return pd.DataFrame({"batch": np.array(batches, np.int64), "named": False, "posts": posts})


def _sums(frames: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """Rows of pre-tokens to the sums that this task knows for the documents of each batch; the rows that
    name a batch's documents pass through."""
    held = _Held()
    last: tuple[str | None, int] = (None, 0)  # the pre-token that the next frame may go on with

    def add(batches: list[int], tokens: list[str], posts: list[bytes]) -> Iterator[pd.DataFrame]:
        nonlocal last
        new = [t for t in dict.fromkeys(tokens) if t != last[0]]
        pieces = dict(zip(new, vocabulary(path).pieces(new).tolist())) | {last[0]: last[1]}
        of = np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens))
        last = (tokens[-1], int(of[-1]))
        held.add(*products(np.array(batches, np.int64), of, posts))
        if held.n > HELD_SUMS:
            yield held.told()

    waiting: tuple[list, list, list] = ([], [], [])
    size = 0
    for pdf in frames:
        named = pdf["token"].isna()
        if named.any():
            yield pdf.loc[named, ["batch", "posts"]].assign(named=True)[["batch", "named", "posts"]]
            pdf = pdf[~named]
        for to, name in zip(waiting, ("batch", "token", "posts")):
            to.extend(pdf[name].tolist())
        size += sum(map(len, pdf["posts"]))
        if len(waiting[0]) >= WAITING_ROWS or size >= WAITING_BYTES:
            yield from add(*waiting)
            waiting, size = ([], [], []), 0
    if waiting[0]:
        yield from add(*waiting)
    if held.n:
        yield held.told()


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    null, ids, n_bytes = unpack_names(pdf.loc[pdf["named"], "posts"].iloc[0])
    sums = np.zeros(len(ids), np.int64)
    for posts in pdf.loc[~pdf["named"], "posts"]:
        docs, counts = unpack(posts)
        sums[docs] += counts
    known = pd.array(ids, "Int64")
    known[null] = pd.NA
    return pd.DataFrame({"doc_id": known, "n_bytes": n_bytes, "n_tokens": sums})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of ``docs`` (doc_id, text)."""
    of = F.when(F.col("token").isNull(), F.xxhash64("batch")).otherwise(F.xxhash64("token", "part"))
    dealt = frequencies(docs, path).repartition(of).sortWithinPartitions("token")
    known = dealt.mapInPandas(lambda frames: _sums(frames, path), SUMS)
    return known.groupBy("batch").applyInPandas(_totals, "doc_id long, n_bytes long, n_tokens long")
