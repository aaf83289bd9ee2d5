"""Arithmetic with IEEE results where ANSI mode would raise: division by zero and logarithms of zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def ieee_div(a, b) -> Column:
    """a / b as doubles: NaN for 0/0, signed infinity for x/0."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    zero = (
        F.when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def finite(x) -> Column:
    """Neither null, NaN nor infinite."""
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
