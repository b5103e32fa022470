"""Aggregates that do not depend on the order of rows, and safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column, scale: int = 4) -> Column:
    """Sum of a double column through decimals: the same in any row order."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def exact_mean(c: Column, scale: int = 4) -> Column:
    """Mean over the non-null values through an exact sum; null if there are none."""
    return F.try_divide(exact_sum(c, scale), F.count(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null if either is null or b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(ratio(a, b) * 100, digits)


def ordered_pick(values: Column, share: Column | float) -> Column:
    """Of an ascending array the element at int(share * n), clamped; null if empty."""
    n = F.size(values)
    at = F.greatest(F.lit(0), F.least(F.floor(F.lit(share) * n if isinstance(share, float) else share * n).cast("int"), n - 1))
    return F.try_element_at(values, at + 1)
