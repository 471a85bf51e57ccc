"""The ways in which an amount can be missing, and rounding that any engine repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column | str) -> Column:
    """Neither null nor zero."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != 0)


def or_zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles; null where b is 0."""
    b = b.cast("double")
    return a.cast("double") / F.when(b != 0, b)


def rounded(c: Column, digits: int = 6) -> Column:
    """Half up, by floor(), so that it's the same arithmetic everywhere."""
    unit = float(10**digits)
    return F.floor(c * F.lit(unit) + F.lit(0.5)) / F.lit(unit)
