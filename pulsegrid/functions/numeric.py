"""Column expressions for rounding, clamping and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Half-even rounding that stays in generated code.

    Below nine digits the value is first settled at nine, so the order in which a sum was
    added up cannot decide a tie.
    """
    if digits == 0:
        return F.rint(value)
    if digits < 9:
        value = F.rint(value * F.lit(1e9)) / F.lit(1e9)
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def unit(value: Column) -> Column:
    """Clamp to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def clean_unit(value: Column) -> Column:
    """Non-finite or missing values become 0, the rest is clamped to [0, 1]."""
    infinite = value.isin(float("inf"), float("-inf"))
    return F.when(value.isNull() | F.isnan(value) | infinite, F.lit(0.0)).otherwise(unit(value))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0, digits: int | None = None) -> Column:
    """numerator/denominator with a per-metric default for an empty denominator."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    if digits is not None:
        value = round_half_even(value, digits)
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def flag_sum(condition: Column) -> Column:
    """Number of rows for which the condition holds."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))
