"""Event codes from measurements, as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DimensionSpec:
    """How one column becomes event codes.

    ``width`` > 0 without intervals: equal-width bins from ``low``.  ``width`` <= 0 with intervals: the
    number of the half-open interval.  Both: equal-width bins below and above the intervals.
    """

    name: str
    low: float = 0.0
    high: float = 0.0
    width: float = -1.0
    intervals: Sequence[tuple[float, float]] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if self.width <= 0 and not self.intervals:
            raise ValueError(f"{self.name}: a width or intervals are needed")
        if any(a >= b for a, b in self.intervals) or any(
            x[1] > y[0] for x, y in zip(self.intervals, self.intervals[1:])
        ):
            raise ValueError(f"{self.name}: intervals must be ascending and not overlap")


def clip(value: Column) -> Column:
    """Negative readings are sensor noise."""
    return F.when(value < 0, F.lit(0).cast("double")).otherwise(value)


def equal_width(value: Column, low: float, width: float) -> Column:
    """Truncates toward zero; the upper bound plays no part, codes below ``low`` may be negative."""
    return ((value - F.lit(low)) / F.lit(width)).cast("int")


def _inside(value: Column, intervals: Sequence[tuple[float, float]], offset: int, otherwise: Column) -> Column:
    out = otherwise
    for k, (start, end) in reversed(list(enumerate(intervals))):
        out = F.when((value >= start) & (value < end), F.lit(k + offset)).otherwise(out)
    return out


def _no_interval(name: str, value: Column, strict: bool) -> Column:
    if not strict:
        return F.lit(None).cast("int")
    return F.raise_error(F.concat(F.lit(f"{name}: no interval holds "), value.cast("string"))).cast("int")


def event_code(spec: DimensionSpec, value: Column, strict: bool = True) -> Column:
    """The code of ``value``; where no interval holds it, an error, or null unless ``strict``.

    A null reading gives a null code.
    """
    gap = _no_interval(spec.name, value, strict)
    if not spec.intervals:
        return equal_width(value, spec.low, spec.width)
    if spec.width <= 0:
        code = _inside(value, spec.intervals, 0, gap)
    else:
        first, last = spec.intervals[0][0], spec.intervals[-1][1]
        below = math.ceil((first - spec.low) / spec.width)
        above = equal_width(value, last, spec.width) + F.lit(len(spec.intervals) + below)
        code = F.when(value < first, equal_width(value, spec.low, spec.width)).when(value >= last, above)
        code = code.otherwise(_inside(value, spec.intervals, below, gap))
    return F.when(value.isNotNull(), code)


_NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?inf)"
#: ``a-b``: either bound may be negative or have an exponent.
_SPAN = re.compile(f"{_NUMBER}-{_NUMBER}")


def parse_spec(text: str) -> DimensionSpec:
    """``name,min,max,width[,column][,a-b#c-d]``; the column number of stored files is skipped.

    What does not parse is an error: a lost interval would shift the codes of those behind it.
    """
    parts = [p.strip() for p in text.split(",")]
    if len(parts) < 4:
        raise ValueError(f"not a dimension: {text!r}")
    name, low, high, width = parts[0], *map(float, parts[1:4])
    more = parts[4:]
    if more and more[0].isdigit():
        more = more[1:]
    if len(more) > 1:
        raise ValueError(f"not a dimension: {text!r}")
    pairs = []
    for span in more[0].split("#") if more and more[0] else []:
        found = _SPAN.fullmatch(span.strip())
        if found is None:
            raise ValueError(f"{name}: not an interval: {span!r}")
        pairs.append((float(found[1]), float(found[2])))
    return DimensionSpec(name, low, high, width, tuple(pairs))


def render_spec(spec: DimensionSpec, column: int) -> str:
    fields = [spec.name, f"{spec.low!r}", f"{spec.high!r}", f"{spec.width!r}", str(column)]
    if spec.intervals:
        fields.append("#".join(f"{a!r}-{b!r}" for a, b in spec.intervals))
    return ",".join(fields)


def as_text(value: Column) -> Column:
    """A raw reading in place of a code."""
    return value.cast("string")
