"""Numeric helpers applied where a result leaves an operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals kept beyond the wanted ones at least, and kept in all for smaller values: what partial sums added in another order leave
#: lies below them. So only that is cleared before the one rounding that shows.
SPARE_DIGITS = 4
CLEAR_DIGITS = ((1e2, 11), (1e4, 9))


def edge_round(value: Column, digits: int = 2) -> Column:
    """Round half away from zero for output; 12.3449996 is 12.34, and 12.345 less the last bits of a sum is 12.35."""
    out = F.round(value, digits + SPARE_DIGITS)
    for limit, kept in reversed(CLEAR_DIGITS):
        out = F.when(F.abs(value) < limit, F.round(value, max(kept, digits + SPARE_DIGITS))).otherwise(out)
    return F.round(out, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; NULL when the denominator is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return F.lit(100.0) * ratio(numerator, denominator)


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def long_count(value: Column | None = None) -> Column:
    """Row count, or the non-null count of a column."""
    return F.count(F.lit(1) if value is None else value)


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower limit the value reaches; steps go from high to low."""
    expr = None
    for limit, label in steps:
        test = value >= F.lit(limit)
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(otherwise)
