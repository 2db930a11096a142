"""Quality rules by compression bands.

Zstandard ratios (bytes before / bytes after) of the whole document and of fixed chunks are held
against bands that depend on length: text above its band repeats itself, text below it does not
compress as language does.  The bands are the corpus's own: over all documents, the ratios of each class
of lengths (a quarter of an octave, with its neighbours) and of each size of chunk are counted, and a band
reaches so many spreads to both sides of the median, the spread being the lesser half of the middle 50 %.
A class with few documents leans on a fixed band, by ``PRIOR_TEXTS`` against its count.

Chunks cover the whole text from ``CHUNKED_FROM`` bytes on: what is left after the full chunks is judged as
one more chunk, which ends with the text and overlaps the one before.  Base rules (too few words, too many
repeated words) come first.

Nulls and empty texts count as having no word, so the base rule rejects them; they have no part in the
bands.  Repeated rows are judged alike.  Extra columns play no part.  An empty table gives an empty one.
A very long text is judged whole, in memory in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Where the corpus has few texts of a length: (bytes from, least ratio, greatest ratio) of a whole document, for
#: zstandard level 3, and so many texts does this band count as.
PRIOR_TEXTS = 20
#: Short frames cannot compress, so no band holds below 64 bytes.
WHOLE_BANDS: Sequence[tuple[int, float, float]] = (
    (0, 0.0, 1e9),
    (64, 0.70, 2.0),
    (128, 0.85, 2.3),
    (256, 1.05, 2.6),
    (512, 1.20, 2.8),
    (1024, 1.35, 3.0),
    (2048, 1.40, 3.2),
    (8192, 1.45, 3.8),
    (32768, 1.50, 4.5),
)
CHUNK_BYTES = 4096
CHUNK_BAND = (1.35, 3.4)
#: (bytes of the text below, chunk bytes, least ratio, greatest ratio): shorter texts have smaller chunks, each
#: with a band for its length.
SMALL_CHUNKS: Sequence[tuple[int, int, float, float]] = (
    (2048, 512, 1.25, 2.8),
    (8192, 1024, 1.35, 3.0),
)
#: Texts below this many bytes are held against the whole band only.
CHUNKED_FROM = 1024
#: A document goes when more than this share of its chunks lies outside the band.
CHUNK_SHARE = 0.25
LEVEL = 3
#: Classes of lengths in an octave, texts below so many bytes have no band, and steps of ln(ratio) in its counts.
CLASSES = 4
BANDED_FROM = 64
STEPS = 400
#: Spreads from the median to the ends of a band.
WHOLE_SPREADS = 5.0
CHUNK_SPREADS = 6.0
#: The quartile of a normal distribution: a spread is about a standard deviation.
_QUARTILE = 0.6745
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"
)


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    ids = dict.fromkeys(words)
    for i, w in enumerate(ids):
        ids[w] = i
    base = len(ids)
    if base == n:
        return 0
    one = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    codes = one  # codes of windows of growing length; each stays below n
    for k in range(1, window):
        both = codes[:-1] * base + one[k:]
        if k == window - 1:
            break
        distinct, codes = np.unique(both, return_inverse=True)
        if len(distinct) == len(both):
            return 0
    _, codes, counts = np.unique(both, return_inverse=True, return_counts=True)
    again = counts[codes] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def band_of(n_bytes: int, bands: Sequence[tuple[int, float, float]]) -> tuple[float, float]:
    low, high = 0.0, 1e9
    for start, lo, hi in bands:
        if n_bytes < start:
            break
        low, high = lo, hi
    return low, high


def chunks_of(n_bytes: int, chunk_bytes: int, chunk_band: tuple[float, float]) -> tuple[list[int], int, tuple[float, float]]:
    """Starts of the chunks of a text, their bytes and their band; the last chunk ends with the text."""
    if n_bytes < min(CHUNKED_FROM, chunk_bytes):
        return [], chunk_bytes, chunk_band
    for below, small, low, high in SMALL_CHUNKS:
        if n_bytes < below and small < chunk_bytes:
            chunk_bytes, chunk_band = small, (low, high)
            break
    starts = list(range(0, n_bytes - chunk_bytes + 1, chunk_bytes))
    if n_bytes % chunk_bytes:
        starts.append(n_bytes - chunk_bytes)
    return starts, chunk_bytes, chunk_band


class Limits(NamedTuple):
    """(least, greatest) ratio by class of length of whole texts, and by bytes of a chunk."""

    whole: dict[int, tuple[float, float]]
    chunks: dict[int, tuple[float, float]]


def length_class(n_bytes: int) -> int:
    return int(CLASSES * math.log2(n_bytes)) if n_bytes else -1


def prior_of(kind: int, of: int) -> tuple[float, float]:
    """The fixed band of a class of lengths (kind 0) or of a chunk's bytes (kind 1)."""
    if kind == 0:
        return band_of(math.ceil(2 ** (of / CLASSES)), WHOLE_BANDS)
    return next(((low, high) for _, size, low, high in SMALL_CHUNKS if size == of), CHUNK_BAND)


def band_of_counts(steps: np.ndarray, counts: np.ndarray, spreads: float, prior: tuple[float, float]) -> tuple[float, float]:
    """The band of ratios given as steps of their logarithm (sorted) and how often each occurs."""
    upto = np.cumsum(counts)
    n = int(upto[-1])
    low, middle, high = (float(steps[np.searchsorted(upto, q * n)]) / STEPS for q in (0.25, 0.5, 0.75))
    spread = max(min(middle - low, high - middle), 1 / STEPS) / _QUARTILE
    own = math.exp(middle - spreads * spread), math.exp(middle + spreads * spread)
    return tuple((n * a + PRIOR_TEXTS * b) / (n + PRIOR_TEXTS) for a, b in zip(own, prior))


def limits_of(counts: pd.DataFrame) -> Limits:
    """``counts``: kind (0 whole, 1 chunk), class, step and n; a row for each that occurs."""
    found: tuple[dict, dict] = ({}, {})
    for kind, spreads in ((0, WHOLE_SPREADS), (1, CHUNK_SPREADS)):
        of_kind = counts[counts["kind"] == kind]
        for of in sorted(set(of_kind["class"].tolist())):
            near = of_kind[(of_kind["class"] - of).abs() <= (1 if kind == 0 else 0)]
            near = near.groupby("step")["n"].sum().sort_index()
            found[kind][of] = band_of_counts(near.index.to_numpy(), near.to_numpy(), spreads, prior_of(kind, of))
    return Limits(*found)


def corpus_limits(docs: DataFrame, text_col: str = "text") -> Limits:
    """The bands of a corpus, from the ratios of all its texts.

    Executors count; the driver gets a row for each class and step of ln(ratio), which do not grow with the corpus.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for pdf in frames:
            rows = []
            for text in pdf["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < BANDED_FROM:
                    continue
                rows.append((0, length_class(len(raw)), len(raw) / len(press(raw))))
                starts, size, _ = chunks_of(len(raw), CHUNK_BYTES, CHUNK_BAND)
                rows += [(1, size, size / len(press(raw[k : k + size]))) for k in starts]
            found = pd.DataFrame(rows, columns=["kind", "class", "ratio"])
            found["step"] = np.rint(STEPS * np.log(found.pop("ratio").to_numpy(float))).astype(int)
            yield found.groupby(["kind", "class", "step"]).size().reset_index(name="n")

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInPandas(count, "kind int, class int, step int, n long")
    return limits_of(counted.groupBy("kind", "class", "step").agg(F.sum("n").alias("n")).toPandas())


def judge_texts(
    texts, bands=WHOLE_BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, chunk_share=CHUNK_SHARE, limits: Limits | None = None
):
    """A row of ``SCHEMA`` for each text; ``limits`` go before the fixed bands, where they have the text's length."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL).compress
    limits = limits or Limits({}, {})
    rows = []
    for text in texts:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes: ASCII white space alone separates
        n = len(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        repeat = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        low, high = limits.whole.get(length_class(len(raw))) or band_of(len(raw), bands)
        ratio = len(raw) / len(press(raw)) if raw else 0.0
        starts, size, fixed = chunks_of(len(raw), chunk_bytes, chunk_band)
        least, most = limits.chunks.get(size, fixed)
        n_chunks = len(starts)
        bad = sum(not least <= size / len(press(raw[k : k + size])) <= most for k in starts)
        good = low <= ratio <= high and bad <= chunk_share * n_chunks
        rows.append(
            (
                n,
                len(text) - sum(map(text.count, WHITE)),
                sum(map(text.count, SYMBOLS)),
                len(lines) - len(set(lines)),
                repeat,
                failed,
                good and not failed,
                ratio,
                bad,
                n_chunks,
            )
        )
    return rows


def quality_verdict(text="text", **limits):
    """A struct column with the counts, ``base_failed``, ``kept`` and the ratios of each text."""

    @F.pandas_udf(SCHEMA)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge_texts(texts, **limits), columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return verdict(F.col(text).cast("string"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """One row per row of ``docs``: its id and every count and verdict; ``limits`` are those of ``docs`` if none are given."""
    limits = limits or corpus_limits(docs, text_col)
    judged = docs.select(F.col(id_col).alias("doc_id"), quality_verdict(text_col, limits=limits).alias("v"))
    return judged.select("doc_id", "v.*")


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    return docs.where(quality_verdict(text_col, limits=limits or corpus_limits(docs, text_col))["kept"])
