"""Byte-level BPE encoding and decoding through a pair occurrence index.

The distinct pre-tokens of a batch lie in one symbol array.  An index maps each adjacent pair that
has a merge to all its positions.  Active ranks are applied in ascending order: every position of
the pair merges at once and the lists of the pairs that this makes are brought up to date.  What a
worker has encoded stays in a bounded cache, so each batch only indexes pre-tokens new to it.

The vocabulary is the JSON file of the tokenizers library; its path is a parameter and every worker
reads it where the library is installed.  Null text counts as empty.  Special strings inside a text
become their own id, as the library does by default.  Repeated rows are encoded alike, row by row; an
empty table gives an empty one.  A long text is never cut: it is encoded at once, in memory in proportion
to its length, and what a worker holds besides is bounded by ``STEP_CHARS`` and ``CACHE_ENTRIES``.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import small_batches

#: Fixed value: white space, and how byte-level vocabularies split text before merging.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_SPLIT = (
    r" ?[{letter}]+| ?[{digit}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{digit}]+"
    r"|[{space}]+(?![^{space}])|[{space}]+"
)
PRETOKEN = _SPLIT.format(letter=r"\p{L}", digit=r"\p{N}", space=_SPACE)
#: The same split for texts in Latin letters, in classes that need no Unicode tables; a text with
#: any character of ``NOT_LATIN`` takes the general one.
PRETOKEN_LATIN = _SPLIT.format(letter=r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", digit="0-9", space=_SPACE)
NOT_LATIN = r"[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ -⁯₠-₿]"
#: Pre-tokens that a worker remembers, and characters of text that it splits before it merges.
CACHE_ENTRIES = 300_000
STEP_CHARS = 1 << 20
_DEAD = -2
_BREAK = -1


def byte_characters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in token) for token, i in ids.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_id[b] = ids[c]
        #: pair of ids -> (rank, id of the merged token)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.pair_of: list[tuple[int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            key = (ids[left], ids[right])
            self.merge.setdefault(key, (rank, ids[left + right]))
            self.pair_of.append(key)
        made = {new: rank for rank, new in self.merge.values()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        for (left, right), (rank, _) in self.merge.items():
            if rank <= max(made.get(left, -1), made.get(right, -1)):
                raise ValueError("merges must follow those that make their parts")
        keys = np.array([(a << 32) | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        of = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self._token_ends = np.concatenate(([0], np.cumsum([len(x) for x in of])))
        self._token_bytes = np.frombuffer(b"".join(of), np.uint8)
        self._general = regex.compile(PRETOKEN).findall
        self._latin = re.compile(PRETOKEN_LATIN).findall
        self._not_latin = re.compile(NOT_LATIN).search
        longest_first = sorted(self.special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.forget()

    def forget(self) -> None:
        self.number = Numbering()
        self.ids = np.zeros(0, "<u4")  # of all numbered pre-tokens, one after another
        self.ends = np.zeros(1, np.int64)  # where those of each end; the first entry is where they begin

    def pretokens(self, text: str) -> list[str]:
        return (self._latin if text.isascii() or not self._not_latin(text) else self._general)(text)

    def _by_rank(self, symbols: np.ndarray, at: np.ndarray, then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(rank, positions) of those pairs of ``symbols[at]`` and ``symbols[then]`` that merge."""
        keys = (symbols[at] << 32) | (symbols[then] & 0xFFFFFFFF)
        slot = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        found = np.flatnonzero(self._keys[slot] == keys)
        if not len(found):
            return
        ranks, at = self._ranks[slot[found]], at[found]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(ranks[a]), at[a:b]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, which are distinct pre-tokens, and the number of ids of each."""
        raw = [w.encode("utf-8", "replace") for w in words]
        if not raw:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        sym = np.insert(self.byte_id[np.frombuffer(b"".join(raw), np.uint8)], ends, _BREAK)
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(at: np.ndarray, then: np.ndarray) -> None:
            for rank, where in self._by_rank(sym, at, then):
                if rank in index:
                    index[rank].append(where)
                else:
                    index[rank] = [where]
                    heapq.heappush(queue, rank)

        note(np.arange(n - 1), np.arange(1, n))
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            left, right = self.pair_of[rank]
            at = at[sym[at] == left]
            at = at[sym[after[at]] == right]  # an earlier merge may have taken one of the two
            if not len(at):
                continue
            if left == right and len(at) > 1:  # in a run of equal symbols every other pair merges
                first = np.flatnonzero(np.concatenate(([True], after[at[:-1]] != at[1:])))
                run = np.repeat(first, np.diff(np.append(first, len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            gone = after[at]
            sym[at] = self.merge[(left, right)][1]
            sym[gone] = _DEAD
            then = after[at] = after[gone]
            before[then] = at
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            at = np.concatenate((ahead, at))
            note(at, after[at])
        merged = sym[sym != _DEAD]
        stops = np.flatnonzero(merged == _BREAK)
        return merged[merged != _BREAK].astype("<u4"), np.diff(stops, prepend=-1) - 1

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special string counts as one."""
        if self._split is None or not any(s in text for s in self.special):
            return self.pretokens(text)
        words: list[str] = []
        for part in self._split.split(text):
            words += [part] if part in self.special else self.pretokens(part)
        return words

    def pieces(self, words: list[str]) -> np.ndarray:
        """How many ids each of these distinct pre-tokens has."""
        special = np.array([w in self.special for w in words], bool)
        _, lengths = self.encode_words([w for w in words if w not in self.special])
        out = np.ones(len(words), np.int64)
        out[~special] = lengths
        return out

    def _learn(self) -> None:
        """Encode the pre-tokens that have a number but no ids yet."""
        new = list(islice(self.number, len(self.ends) - 1, None))
        ids, lengths = self.encode_words([w for w in new if w not in self.special])
        if any(w in self.special for w in new):
            at = np.flatnonzero([w in self.special for w in new])
            before = np.cumsum(np.concatenate(([0], lengths)))[at - np.arange(len(at))]
            ids = np.insert(ids, before, [self.special[new[i]] for i in at])
            lengths = np.insert(lengths, at - np.arange(len(at)), 1)
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for step in _steps(texts):
            out += self._assemble([np.fromiter(map(self.number.__getitem__, self.words(t or "")), np.int32) for t in step])
        return out

    def _assemble(self, step: list[np.ndarray]) -> list[bytes]:
        self._learn()
        numbers = np.concatenate(step)
        begin, end = self.ends[numbers], self.ends[numbers + 1]
        stops = np.concatenate(([0], np.cumsum(end - begin)))
        ids = self.ids[np.repeat(begin - stops[:-1], end - begin) + np.arange(stops[-1])].tobytes()
        cuts = 4 * stops[np.concatenate(([0], np.cumsum([len(x) for x in step])))]
        if len(self.number) > CACHE_ENTRIES:
            self.forget()
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4")
        begin, end = self._token_ends[tokens], self._token_ends[tokens + 1]
        stops = np.concatenate(([0], np.cumsum(end - begin)))
        raw = self._token_bytes[np.repeat(begin - stops[:-1], end - begin) + np.arange(stops[-1])]
        return raw.tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` and a binary column of little-endian unsigned 32-bit ids.

    With ``back``, a column of that name has what the ids decode to; the same pass makes both, so that only one
    worker for each task holds a vocabulary.  Columns of ``docs`` that already have these names are replaced.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for texts in batches:
            for part in _steps(texts.tolist()):
                ids = v.encode_batch(part)
                yield pd.DataFrame({"ids": ids, "text": [v.decode(x) if back else None for x in ids]}, columns=["ids", "text"])

    coded = F.pandas_udf(run, "ids binary, text string")
    # Marked so that the planner keeps it apart: folded into what reads the ids, it would run once for each reader.
    coded = docs.withColumn("__coded", coded.asNondeterministic()(F.col(text_col).cast("string")))
    coded = coded.withColumn(out, F.col("__coded.ids"))
    return (coded.withColumn(back, F.col("__coded.text")) if back else coded).drop("__coded")


def _steps(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about ``STEP_CHARS`` characters."""
    step: list[str | None] = []
    size = 0
    for text in texts:
        step.append(text)
        size += len(text or "")
        if size >= STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


def decode(path: str, ids_col: str = "ids") -> Column:
    """The text of a column of ids, special tokens included; null ids give null."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        v = vocabulary(path)
        return pd.Series([None if x is None else v.decode(x) for x in ids])

    return texts(F.col(ids_col))
