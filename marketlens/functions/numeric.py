"""Numeric helpers with engine-independent results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums go through fixed point: the result does not depend on the order in which partial
# sums meet, so every run (and every engine) gets the same value.  The scales hold all
# digits of a double's decimal text below 1e9, and of larger ones below 1e18.
FIXED = ((1e9, "decimal(38,18)"), (1e18, "decimal(38,8)"))


def exact_sum(col: str | Column) -> Column:
    """SUM as a double: NULLs are skipped; NaN and infinities propagate as in a plain SUM."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    size, parts, low = F.abs(c), [], 0.0
    for high, kind in FIXED:
        part = F.when((size >= F.lit(low)) & (size < F.lit(high)), c)  # false for NaN, which sorts above all numbers
        parts.append(F.sum(part.cast(kind)).cast("double"))
        low = high
    parts.append(F.sum(F.when(size >= F.lit(low), c)))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return F.when(F.count(c) > 0, total)


def exact_avg(col: str | Column) -> Column:
    """AVG over the non-NULL values; one NaN makes it NaN, as in a plain AVG."""
    c = F.col(col) if isinstance(col, str) else col
    return exact_sum(c) / F.nullif(F.count(c), F.lit(0))


def shown(avg: str, places: int) -> Column:
    """An average as a report shows it: float noise beyond nine digits goes before rounding,
    so that a mean of 2.25 computed as 2.2499999999999996 shows as 2.3, not 2.2."""
    return F.round(F.round(avg, 9), places)


def count_if(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END): NULL conditions are not counted."""
    return F.count(F.when(cond, F.lit(1)))


def ratio(num: Column, den: Column) -> Column:
    """num / NULLIF(den, 0) on doubles."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
