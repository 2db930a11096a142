"""Rules that call a window bad, as column expressions over a fixed-length frame.

A rule sees the frame of ``length`` rows that starts at each row: sums, extremes, first and last values.
``standard`` is the threshold of the measure and ``percent`` that of the increase; a negative threshold is
not applied, and a rule without ``percent`` applies the standard one alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    """The window that starts at each row; ``order`` is an unframed, ordered window."""

    order: WindowSpec
    length: int

    def _over(self, c: Column) -> Column:
        return c.over(self.order.rowsBetween(0, self.length - 1))

    def sum(self, name: str) -> Column:
        return self._over(F.sum(name))

    def avg(self, name: str) -> Column:
        return self.sum(name) / F.lit(self.length)

    def min(self, name: str) -> Column:
        return self._over(F.min(name))

    def max(self, name: str) -> Column:
        return self._over(F.max(name))

    def first(self, name: str) -> Column:
        return F.col(name)

    def last(self, name: str) -> Column:
        return F.lead(name, self.length - 1).over(self.order)

    def increase(self, name: str) -> Column:
        """Per cent from the first to the last row; null unless both are positive and it rises."""
        first, last = self.first(name), self.last(name)
        return F.when((first > 0) & (last > first), F.lit(100) * (last - first) / first)


@dataclass(frozen=True)
class WindowRule:
    kind: str
    length: int
    standard: float = -1.0
    percent: float = -1.0
    guard: float | None = 3000.0

    def __post_init__(self) -> None:
        if self.kind not in RULES:
            raise ValueError(f"no rule {self.kind!r}")
        if self.length < 1:
            raise ValueError("a window needs a row")
        if self.standard < 0 and self.percent < 0:
            raise ValueError("both thresholds are negative")
        if self.kind in STANDARD_ONLY and self.standard < 0:
            raise ValueError(f"{self.kind} compares its measure with the standard threshold, which is missing")
        if self.kind in PERCENT_ONLY and self.percent < 0:
            raise ValueError(f"{self.kind} compares the model's error with the per cent threshold, which is missing")

    def __call__(self, frame: Frame) -> Column:
        return F.coalesce(RULES[self.kind](self, frame), F.lit(False))


def _sensor_on(rule: WindowRule, frame: Frame, name: str) -> Column:
    return F.lit(True) if rule.guard is None else frame.max(name) <= F.lit(rule.guard)


def _combined(rule: WindowRule, measure: Column, increase: Column) -> Column:
    high, risen = measure > F.lit(rule.standard), increase > F.lit(rule.percent)
    if rule.percent < 0:
        return high
    return risen & high if rule.standard >= 0 else risen


def _average(value: str, guard: str) -> Callable[[WindowRule, Frame], Column]:
    def rule(r: WindowRule, f: Frame) -> Column:
        return _sensor_on(r, f, guard) & (f.sum(value) > 0) & (f.avg(value) > F.lit(r.standard))

    return rule


def _every_row(value: str, guard: str) -> Callable[[WindowRule, Frame], Column]:
    def rule(r: WindowRule, f: Frame) -> Column:
        good = _sensor_on(r, f, guard) & (f.min(value) > F.lit(r.percent)) & (f.sum(value) > 0) & (f.first(value) > 0)
        return good & _combined(r, f.avg(value), f.avg(value))

    return rule


def _rising(value: str, guard: str, risen: str, total: bool = False) -> Callable[[WindowRule, Frame], Column]:
    def rule(r: WindowRule, f: Frame) -> Column:
        measure = f.sum(value) if total else f.avg(value)
        return _sensor_on(r, f, guard) & (f.sum(value) > 0) & _combined(r, measure, f.increase(risen))

    return rule


def _specific(rate: str, guard: str | None, rising: bool) -> Callable[[WindowRule, Frame], Column]:
    """Grams for a kilowatt hour of brake work; a window without work is never bad, whatever the thresholds."""

    def rule(r: WindowRule, f: Frame) -> Column:
        on = _sensor_on(r, f, guard) if guard else F.lit(True)
        work = f.sum("brake_power")
        measure = F.lit(3600) * f.sum(rate) / F.when(work > 0, work)
        return on & (work > 0) & (_combined(r, measure, f.increase(rate)) if rising else measure > F.lit(r.standard))

    return rule


def _model_error(sign: int) -> Callable[[WindowRule, Frame], Column]:
    """The model's mean against the sensor's, in per cent: both signs (0), too low (-1) or too high (1)."""

    def rule(r: WindowRule, f: Frame) -> Column:
        sensed = f.avg("sensor")
        error = F.lit(100) * (f.avg("model") - sensed) / F.when(sensed > 0, sensed)
        if sign == 0:
            return F.abs(error) > F.lit(r.percent)
        return error > F.lit(r.percent) if sign > 0 else error < F.lit(-r.percent)

    return rule


RULES: dict[str, Callable[[WindowRule, Frame], Column]] = {
    "abs_standard": _average("abs_error", "theory"),
    "abs_every_row": _every_row("abs_error", "theory"),
    "rel_standard": _average("rel_error", "theory"),
    "rel_increase_sum": _rising("rel_error", "theory", "rel_error", total=True),
    "rel_increase_avg": _rising("rel_error", "theory", "rel_error"),
    "rel_standard_guarded": _average("rel_error", "rel_error"),
    "theory_increase": _rising("rel_error", "theory", "theory"),
    "specific_nox": _specific("nox_rate", "nox_ppm", False),
    "specific_nox_increase": _specific("nox_rate", "nox_ppm", True),
    "specific_co2": _specific("co2_rate", None, False),
    "specific_co2_increase": _specific("co2_rate", None, True),
    "model_error": _model_error(0),
    "model_under": _model_error(-1),
    "model_over": _model_error(1),
}

#: Kinds that use one threshold only, which must then be given.
STANDARD_ONLY = frozenset({"abs_standard", "rel_standard", "rel_standard_guarded", "specific_nox", "specific_co2"})
PERCENT_ONLY = frozenset({"model_error", "model_under", "model_over"})

#: Kinds by the error that they look for: the model too low, off either way, too high.
ERROR_TYPES = {-1: "model_under", 0: "model_error", 1: "model_over"}


def model_rule(error_type: int, length: int, percent: float) -> WindowRule:
    """The rule of a model's error by its type: -1, 0 or 1."""
    if error_type not in ERROR_TYPES:
        raise ValueError(f"no error type {error_type!r}")
    return WindowRule(ERROR_TYPES[error_type], length, percent=percent)
