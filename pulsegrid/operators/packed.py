"""Event sequences as whole numbers.

The codes of a dimension lie in a counted range, so a code is a digit and a sequence a number in that base: one long,
or as many as the range and the length ask for.  A set of dimensions is packed the same way, so that a pattern is
mostly one long in a shuffle.  Texts are made from the digits of the patterns that are left in the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bits of a long that are used.
BITS = 62
#: Distinct codes that a dimension of texts may have.
DICTIONARY = 65_536


@dataclass(frozen=True)
class Codec:
    """The digits of one dimension: 0 for a null, else the code's place from ``low`` or in ``values`` on."""

    name: str
    base: int
    low: int = 0
    values: tuple[str, ...] | None = None

    def parts(self, length: int) -> list[tuple[int, int]]:
        """First and last place (exclusive) of the codes in each long."""
        per = 1
        while self.base ** (per + 1) <= 1 << BITS and per < length:
            per += 1
        return [(a, min(a + per, length)) for a in range(0, length, per)]

    def columns(self, length: int) -> list[str]:
        return [f"s{length}_{self.name}_{k}" for k in range(len(self.parts(length)))]

    def spans(self, length: int) -> list[int]:
        return [self.base ** (b - a) for a, b in self.parts(length)]

    def digit(self) -> Column:
        if self.values is None:
            return F.coalesce(F.col(self.name).cast("long") - self.low + 1, F.lit(0).cast("long"))
        return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in self.values]), F.col(self.name).cast("string")), F.lit(0).cast("long"))

    def pack(self, order: WindowSpec, length: int, digit: str) -> dict[str, Column]:
        """The sequence of the next ``length`` rows; ``digit`` names the column of digits."""
        out = {}
        for name, (a, b) in zip(self.columns(length), self.parts(length)):
            total = F.lead(digit, a).over(order)
            for k in range(a + 1, b):
                total = total * self.base + F.lead(digit, k).over(order)
            out[name] = total
        return out

    def text(self, length: int) -> str:
        """SQL for the codes of a packed sequence, joined by spaces; a null code shows as ``?``."""
        shown = []
        for word, (a, b) in zip(self.columns(length), self.parts(length)):
            for k in range(a, b):
                digit = f"(`{word}` div {self.base ** (b - 1 - k)}L % {self.base}L)"
                code = f"cast({digit} + {self.low - 1}L AS string)" if self.values is None else f"array({', '.join(map(_quoted, self.values))})[cast({digit} AS int) - 1]"
                shown.append(f"if({digit} = 0, '?', {code})")
        return f"concat_ws(' ', {', '.join(shown)})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def codecs(series: DataFrame, dimensions: Sequence[str]) -> list[Codec]:
    """A codec for each dimension: from the range of whole codes, one scan for all, or the distinct texts."""
    whole = [d for d in dimensions if isinstance(series.schema[d].dataType, IntegralType)]
    texts = [d for d in dimensions if d not in whole]
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in whole for f in (F.min, F.max)]
    seen = series.agg(*ends).first() if whole else {}
    out = []
    for d in dimensions:
        if d in texts:
            distinct = series.select(F.col(d).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(DICTIONARY + 1)
            values = tuple(sorted(r["v"] for r in distinct.collect()))
            if len(values) > DICTIONARY:
                raise ValueError(f"{d} has more than {DICTIONARY} distinct codes")
            out.append(Codec(d, len(values) + 1, values=values))
        else:
            low, high = seen[f"min_{d}"] or 0, seen[f"max_{d}"] or 0
            if high - low + 2 > 1 << BITS:
                raise ValueError(f"the codes of {d} are too far apart")
            out.append(Codec(d, high - low + 2, low))
    return out


class Layout:
    """How the sets of dimensions of one level become keys.

    The number of a set is the leading digit of the key, its sequences are the others: one long for the level, or as many
    as its largest set asks for; then the key is a struct of them.
    """

    def __init__(self, codecs: Sequence[Codec], length: int, sets: Sequence[Sequence[str]]):
        self.codecs, self.length, self.sets = list(codecs), length, [tuple(s) for s in sets]
        by_name = {c.name: c for c in codecs}
        parts = [[(d, w, column, span) for d in s for w, (column, span) in enumerate(zip(by_name[d].columns(length), by_name[d].spans(length)))] for s in self.sets]
        #: of each set, its longs: [(dimension, place of its long, column, span)]
        self._longs: list[list[list[tuple[str, int, str, int]]]] = []
        for own in parts:
            longs: list[list[tuple[str, int, str, int]]] = [[]]
            filled = len(self.sets)
            for part in own:
                if longs[-1] and filled * part[3] > 1 << BITS:
                    longs.append([])
                    filled = 1
                longs[-1].append(part)
                filled *= part[3]
            self._longs.append(longs)
        #: of each set: (dimension, place of its long) -> (number of the key's long, divisor)
        self.places: list[dict[tuple[str, int], tuple[int, int]]] = []
        self.lead = 1
        for longs in self._longs:
            place = {}
            for n, own in enumerate(longs):
                below = 1
                for d, w, _, span in reversed(own):
                    place[(d, w)] = (n, below)
                    below *= span
                if n == 0:
                    self.lead = max(self.lead, below)
            self.places.append(place)
        self.keys = [f"k{n}" for n in range(max(len(x) for x in self._longs))]
        if self.lead * len(self.sets) > 1 << (BITS + 1):  # a part alone nearly fills a long
            raise ValueError("a sequence of one dimension is too long for its range of codes")

    def key(self, number: int) -> str:
        """SQL for the key of this set at a row: a long, or a struct of several."""
        out = []
        for n, own in enumerate(self._longs[number]):
            rest = f"`{own[0][2]}`"
            for _, _, column, span in own[1:]:
                rest = f"({rest} * {span}L + `{column}`)"
            out.append(rest if n else f"{number * self.lead}L + {rest}")
        out += ["0L"] * (len(self.keys) - len(out))
        return out[0] if len(self.keys) == 1 else f"named_struct({', '.join(f"'{k}', {c}" for c, k in zip(out, self.keys))})"

    def number(self) -> Column:
        """The number of a key's set."""
        return F.expr(f"cast(k0 div {self.lead}L AS int)")

    def words(self) -> list[Column]:
        """The longs of each dimension under the names that the series has for them; null if the set is without it."""

        def by_set(values: Sequence[int]) -> str:
            return f"array({', '.join(f'{v}L' for v in values)})[cast(k0 div {self.lead}L AS int)]"

        out = []
        for codec in self.codecs:
            for w, (column, span) in enumerate(zip(codec.columns(self.length), codec.spans(self.length))):
                at = [p.get((codec.name, w)) for p in self.places]
                below = by_set([x[1] if x else 0 for x in at])  # 0: the set is without the dimension
                long = f"k0 % {self.lead}L"
                if len(self.keys) > 1:
                    n = by_set([x[0] if x else 0 for x in at])
                    long = f"CASE WHEN {n} = 0 THEN {long} {' '.join(f'WHEN {n} = {k} THEN {name}' for k, name in enumerate(self.keys[1:], 1))} END"
                out.append(F.expr(f"if({below} > 0, ({long}) div {below} % {span}L, NULL) AS `{column}`"))
        return out


def texts(codecs: Sequence[Codec], length: int) -> list[Column]:
    """p_<dimension> from the longs of each dimension; null where they are."""
    return [F.expr(f"if(`{c.columns(length)[0]}` IS NOT NULL, {c.text(length)}, NULL) AS `p_{c.name}`") for c in codecs]
