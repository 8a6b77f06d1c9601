"""Column expressions: geometry, circular statistics, clipping and the normal tail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm2(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def concentration(angle: Column, folds: int = 1, where: Column | None = None) -> Column:
    """Aggregate: length of the mean unit vector of ``folds * angle`` (radians), over the rows where ``where`` holds."""
    own = angle * folds if where is None else F.when(where, angle * folds)
    return norm2(F.avg(F.sin(own)), F.avg(F.cos(own)))


def wrapped(angle: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


# Coefficients of a published Chebyshev fit to the complementary error function (relative error 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly) * 0.5
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(n), digits).alias(n) for n in names]
