"""Thresholds, date windows and request limits.

Fixed values that must equal the reference's for identical labels and counts
are gathered in ``Thresholds``; defaults are the reference constants.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    # Fixed values (reference constants, natural order):
    roi_excellent: float = 500.0
    roi_good: float = 300.0
    roi_average: float = 200.0
    elasticity_high: float = 2.0
    elasticity_low: float = 1.0
    price_advantage: float = -15.0
    price_disadvantage: float = 10.0
    price_dominant: float = -30.0
    parity_low: float = -15.0
    parity_high: float = 15.0
    uplift_excellent: float = 40.0
    uplift_good: float = 30.0
    uplift_moderate: float = 20.0
    discount_high: float = 25.0
    repeat_excellent: float = 60.0
    repeat_good: float = 40.0
    repeat_standard: float = 25.0
    acquisition_efficient: int = 100
    acquisition_good: int = 50
    acquisition_standard: int = 20
    cost_per_acquisition_max: float = 50.0
    increase_strong_impact: float = 5.0
    decrease_strategic_impact: float = 10.0
    impact_high: float = 15.0
    impact_significant: float = 10.0
    impact_moderate: float = 5.0
    underpriced_factor: float = 1.1
    overpriced_factor: float = 0.9
    low_cost_budget: float = 20000.0
    battleground_uplift: float = 35.0
    deep_discount_pct: float = 30.0
    high_value_discount: float = 200.0
    standard_discount: float = 20.0
    budget_major: float = 50000.0
    budget_significant: float = 25000.0
    budget_standard: float = 10000.0
    duration_extended: int = 30
    duration_standard: int = 14
    duration_short: int = 7
    insight_gap_band: float = 10.0


DEFAULT_THRESHOLDS = Thresholds()


@dataclass(frozen=True)
class DateWindow:
    """Inclusive date window; ``end=None`` means open-ended."""

    start: dt.date
    end: dt.date | None = None

    @staticmethod
    def of(start: str | dt.date, end: str | dt.date | None = None) -> "DateWindow":
        def as_date(v):
            return v if isinstance(v, dt.date) or v is None else dt.date.fromisoformat(v)

        return DateWindow(as_date(start), as_date(end))

    def contains(self, day: Column) -> Column:
        """Whether a date column lies in the window."""
        inside = day >= F.lit(self.start)
        return inside if self.end is None else inside & (day <= F.lit(self.end))


# The reference hard-codes these two days; they stay the library default (D1).
REFERENCE_WINDOW = DateWindow.of("2024-12-14", "2024-12-15")
# The window used by the registered queries on the driver's data (dates 1995-2001).
STUDY_WINDOW = DateWindow.of("1998-01-01", "1998-12-31")

DEFAULT_LIMIT = 100
MAX_LIMIT = 500


def resolve_limit(limit: int | str | None) -> int:
    """Row cap of a report: default 100, at most 500, negatives rejected."""
    n = DEFAULT_LIMIT if limit is None else int(limit)
    if n < 0:
        raise ValueError(f"limit must be >= 0, got {n}")
    return min(n, MAX_LIMIT)
