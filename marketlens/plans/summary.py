"""Summary statistics of a report: one aggregation, one row.

``rows`` is either the whole labelled result (``scope='full'``) or the top-n
report (``scope='top_n'``, what the reference summarises).  Values are read
from the rounded output columns, as the reference reads its returned rows.
Sums and means are exact (``functions.numeric``), so the answer does not depend on
partitioning; means show nine places.  A NULL metric counts as 0 in sums (the reference would abort the
summary; SURVEY D7) and the divisor of a mean is every row, as there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, Thresholds
from marketlens.functions import count_if, exact_sum


def _distinct_with_null(c: str) -> Column:
    """Distinct values where NULL counts as one value (a Python set of row values)."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def _mean_over_rows(c: str, total: Column) -> Column:
    return F.round(exact_sum(c) / total, 9)  # float noise of the division goes


def _fields(subject: str, total: Column, th: Thresholds) -> list[tuple[str, Column]]:
    if subject == "competitor_tracking":
        return [
            ("unique_competitors", _distinct_with_null("competitor")),
            ("unique_markets", _distinct_with_null("market")),
            ("avg_price_gap", _mean_over_rows("price_gap_pct", total)),
            ("competitive_advantages", count_if(F.col("price_gap_pct") <= th.price_advantage)),
        ]
    if subject == "campaign_performance":
        return [
            ("unique_campaigns", _distinct_with_null("campaign_name")),
            ("total_revenue", exact_sum("revenue_generated")),
            ("total_cost", exact_sum("campaign_cost")),
            ("avg_roi", _mean_over_rows("roi_pct", total)),
        ]
    if subject == "price_elasticity":
        return [
            ("price_points_analyzed", total),
            ("unique_markets", _distinct_with_null("market")),
            ("avg_elasticity", _mean_over_rows("elasticity_coefficient", total)),
            ("price_increase_opportunities", count_if(F.col("recommendation") == "Increase Price")),
        ]
    if subject == "promotional_calendar":
        return [
            ("planned_campaigns", total),
            ("total_budget", exact_sum("budget_usd")),
            ("avg_expected_uplift", _mean_over_rows("expected_uplift_pct", total)),
            ("unique_markets", _distinct_with_null("target_market")),
        ]
    raise ValueError(f"unknown subject {subject!r}")


def summarize(rows: DataFrame, subject: str, thresholds: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """One row: total_records, query_type and the subject's fields (NULL when no rows)."""
    total = F.count(F.lit(1))
    some = total > 0
    fields = _fields(subject, total, thresholds)
    return rows.agg(
        total.alias("total_records"),
        F.when(some, F.lit(subject)).alias("query_type"),
        *[F.when(some, expr).alias(name) for name, expr in fields],
    )
