"""Arithmetic with IEEE results under ANSI SQL: no error on zero divisors, NaN and infinities as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def div(a: Column, b: Column) -> Column:
    """a / b; x/0 is signed infinity, 0/0 and NaN/0 are NaN, null where either is null."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(a / b)


def ln(x: Column) -> Column:
    """Natural logarithm; -inf at 0, NaN below."""
    x = x.cast("double")
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.log(x))


def rounded(x: Column, digits: int) -> Column:
    """x to ``digits`` decimals as SQL engines round doubles: scaled, rounded with halves away from zero, scaled back. ``F.round`` rounds a double's shortest
    decimal text instead, so that the two differ where scaling meets a half. What overflows when scaled stays as it is."""
    x = x.cast("double")
    scaled = x * F.lit(float(10**digits))
    return F.when(finite(scaled), F.round(scaled) / F.lit(float(10**digits))).otherwise(x)


def power(x: Column, n: Column) -> Column:
    return F.pow(x.cast("double"), n.cast("double"))


def finite(x: Column) -> Column:
    """True where x is neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def zero_unless_finite(x: Column) -> Column:
    return F.when(finite(x), x).otherwise(0.0)


def pearson(x: Column, y: Column, over=None, tiny: float = 0.0) -> Column:
    """Correlation over rows where both are present; null, not an error, where either is constant.

    ``over``: a window; without it an aggregate. ``tiny``: product of deviations from which on the result is null too.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))

    def agg(c: Column) -> Column:
        return c if over is None else c.over(over)

    spread = agg(F.stddev_pop(a)) * agg(F.stddev_pop(b))
    return agg(F.covar_pop(a, b)) / F.when(spread > tiny, spread)
