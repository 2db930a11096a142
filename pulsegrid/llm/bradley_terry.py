"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has features; a pair of labelled documents of which one is preferred (label 1 over 0) gives
the difference of their features, and a linear score is learnt by logistic loss on these differences.  The
cut between good and bad is a quantile of the learnt scores of the labelled documents: the one that gets
most of them right.  A score is turned into 0..1 by the logistic function, shifted so that the cut is at
``THRESHOLD``.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled documents, chosen by a hash of their
id, and ``PAIRS`` opponents for each, so that no list of all pairs is made.  All statistics of the fit come
from that sample; scoring covers every whole text of the input.

Null text counts as empty and is scored like any other.  Labels that are null, or of null ids, are not
used.  Without both labels in the sample every score is 0.5.  Repeated rows get equal scores; extra
columns play no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a fit may use at most, and the opponents that each meets.
SAMPLE = 20_000
PAIRS = 8
RIDGE = 1e-3
ROUNDS = 30
#: The score at the learnt cut.
THRESHOLD = 0.7
#: Score and predicted value of the unlearnt model.
_NEUTRAL = 0.5

_MARKS = ("#*$%&<>|~^={}\\", "!", "?", ".,;:", "0123456789", "()[]\"'", "@/_", "\n")
_WORD_MARKS = "#*$%&|!"

NAMES = (
    "log_words", "log_word_length", "long_words", "short_words", "distinct_words", "distinct_pairs", "top_word", "again",
    "dup_lines", "words_a_line", "upper", "upper_words", "marked_words", "non_ascii", "ratio", "entropy",
    *(f"marks_{k}" for k in range(len(_MARKS))),
)


def features(text: str | None) -> list[float]:
    """What a text looks like, in figures that hardly depend on language."""
    import zlib

    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, chars = len(words), max(1, len(text))
    m = max(1, n)
    distinct = dict.fromkeys(words, 0)
    for w in words:
        distinct[w] += 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(raw))
    lengths = [len(w) for w in distinct]
    return [
        math.log1p(n),
        math.log1p(chars / m),
        sum(k > 12 for k in lengths) / max(1, len(lengths)),
        sum(c for w, c in distinct.items() if len(w) <= 3) / m,
        len(distinct) / m,
        pairs / max(1, n - 1),
        max(distinct.values(), default=0) / m,
        sum(map(eq, words, words[1:])) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        int(counts[65:91].sum()) / chars,
        sum(c for w, c in distinct.items() if w.isupper()) / m,
        sum(c for w, c in distinct.items() if w[-1] in _WORD_MARKS) / m,
        int(counts[128:].sum()) / max(1, len(raw)),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        float(-(share * np.log2(share)).sum()),
        *(sum(int(counts[ord(c)]) for c in marks) / chars for marks in _MARKS),
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, with their squares, so that too much and too little can both be bad."""
    x = np.clip(x, -6, 6)
    return np.concatenate([x, x * x / 6], axis=1)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return _expand((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(rows), _NEUTRAL)
        z = self.raw(rows) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, seed: int = 3) -> Model:
    """Logistic loss on feature differences of preferred and other documents, by Newton's method."""
    mean, scale = (rows.mean(axis=0), rows.std(axis=0) + 1e-6) if len(rows) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    x = _expand((rows - mean) / scale)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Model(mean, scale, w, 0.0)
    rng = np.random.default_rng(seed)
    first = np.concatenate([np.repeat(good, pairs), rng.choice(good, pairs * len(bad))])
    second = np.concatenate([rng.choice(bad, pairs * len(good)), np.repeat(bad, pairs)])
    d = x[first] - x[second]
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # how surely the other one would be preferred
        grad = d.T @ p / len(d) - RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = x @ w
    # Each quantile of the scores as the cut: those below are called bad.
    order = np.argsort(raw, kind="stable")
    right = np.concatenate([[0], np.cumsum(labels[order] == 0)]) + np.concatenate([np.cumsum((labels[order] == 1)[::-1])[::-1], [0]])
    best = int(np.argmax(right))
    edge = raw[order]
    cut = (edge[best - 1] + edge[best]) / 2 if 0 < best < len(edge) else edge[0] - 1 if best == 0 else edge[-1] + 1
    return Model(mean, scale, w, float(cut))


def features_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return rows(text.cast("string"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs``: doc_id, text.  ``labels``: doc_id, quality; of repeated ids the least label and the least text are used.

    At most ``sample`` documents, those least by a hash of their ids, come to the driver as 24 figures each.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")  # at most ``sample`` ids
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "label", features_of(F.col("text")).alias("x")).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(NAMES))
    return fit_pairs(x, rows["label"].to_numpy(int))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (1 from ``THRESHOLD`` on)."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts], float).reshape(-1, len(NAMES))
        return pd.Series(model.score(rows))

    scored = docs.select(F.col(id_col).alias("doc_id"), scores(F.col(text_col).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
