"""Rounding and order-independent sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# money is summed as whole ten-thousandths, so a sum never depends on row order
MONEY_STEPS = 10_000


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half up on the binary value (the same rule in every engine)."""
    scale = 10**digits
    return F.floor(value * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def half_up_int(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("bigint")


def as_steps(value: Column) -> Column:
    return F.floor(value * F.lit(float(MONEY_STEPS)) + F.lit(0.5)).cast("bigint")


def exact_sum(value: Column) -> Column:
    """Sum of money, exact to a hundredth of a cent."""
    return F.sum(as_steps(value)) / F.lit(float(MONEY_STEPS))


def exact_avg(value: Column) -> Column:
    """Mean of money; independent of row order and partitioning."""
    return F.sum(as_steps(value)) / F.count(value) / F.lit(float(MONEY_STEPS))


def weighted_avg(value: Column, weight: Column) -> Column:
    """Mean of pre-counted values; null when the weights add up to zero."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.sum(as_steps(value) * weight) / F.nullif(total, F.lit(0)) / F.lit(float(MONEY_STEPS))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def money(value: Column) -> Column:
    """``$1.23`` text of an amount, null for null."""
    return F.when(value.isNotNull(), F.format_string("$%.2f", half_up(value, 2)))


def whole(value: Column) -> Column:
    """Whole-number text of a value."""
    return half_up_int(value).cast("string")
