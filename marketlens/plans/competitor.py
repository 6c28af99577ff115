"""Competitor price tracking and market positioning (CT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, REFERENCE_WINDOW, DateWindow, Thresholds
from marketlens.functions import count_if, exact_avg, labels, shown
from marketlens.plans import label_text as L
from marketlens.sources.layout import month_predicate
from marketlens.plans.base import RankSpec, SubjectPlan, build_plan

SUBJECT = "competitor_tracking"
KEYS = ("market", "product_category")
POSITIVE_IMPACT = ("Positive", "Very Positive")
DETAIL_COLUMNS = (
    "tracking_date", "competitor", "product_category", "market", "own_price_usd",
    "competitor_price_usd", "price_gap_pct", "promotion_flag", "quality_comparison",
    "brand_positioning", "market_share_impact",
)


def detail(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW) -> DataFrame:
    months = month_predicate(facts, SUBJECT, window.start, window.end)  # partition pruning, if laid out
    if months is not None:
        facts = facts.where(months)
    return facts.select(*DETAIL_COLUMNS).where(window.contains(F.col("tracking_date")))


def segment_aggs(th: Thresholds) -> list[Column]:
    gap, impact = F.col("price_gap_pct"), F.col("market_share_impact")
    return [
        F.count_distinct("competitor").alias("competitors_tracked"),
        exact_avg(gap).alias("avg_price_gap_pct"),
        count_if(impact.isin(*POSITIVE_IMPACT)).alias("positive_positioning_count"),
        count_if(F.col("promotion_flag") == "TRUE").alias("competitor_promotions_active"),
        count_if(gap <= th.price_advantage).alias("price_advantages"),
        count_if(gap >= th.price_disadvantage).alias("price_disadvantages"),
        exact_avg("own_price_usd").alias("avg_own_price"),
        exact_avg("competitor_price_usd").alias("avg_competitor_price"),
    ]


def ranks() -> list[RankSpec]:
    return [
        RankSpec("price_competitiveness_rank", [("price_gap_pct", True)], ["market"]),
        RankSpec("overall_competitiveness_rank", [(F.abs(F.col("price_gap_pct")), True)]),
    ]


def segment_view(segments: DataFrame) -> DataFrame:
    """The rollup as the report shows it (rounded)."""
    return segments.select(
        *KEYS, "competitors_tracked",
        shown("avg_price_gap_pct", 1).alias("market_avg_price_gap"),
        "positive_positioning_count", "competitor_promotions_active", "price_advantages",
        "price_disadvantages",
        shown("avg_own_price", 2).alias("market_avg_own_price"),
        shown("avg_competitor_price", 2).alias("market_avg_competitor_price"),
    )


def project(j: DataFrame, th: Thresholds, *more: Column) -> DataFrame:
    gap, impact, flag = F.col("price_gap_pct"), F.col("market_share_impact"), F.col("promotion_flag")
    quality, brand = F.col("quality_comparison"), F.col("brand_positioning")
    return j.select(
        *more,
        "tracking_date", "competitor", "product_category", "market", "own_price_usd",
        "competitor_price_usd", F.round(gap, 1).alias("price_gap_pct"), "promotion_flag",
        "quality_comparison", "brand_positioning", "market_share_impact", "competitors_tracked",
        shown("avg_price_gap_pct", 1).alias("market_avg_price_gap"),
        "positive_positioning_count", "competitor_promotions_active", "price_advantages",
        "price_disadvantages",
        shown("avg_own_price", 2).alias("market_avg_own_price"),
        shown("avg_competitor_price", 2).alias("market_avg_competitor_price"),
        "price_competitiveness_rank", "overall_competitiveness_rank",
        # labels read the unrounded gap (a select alias is not visible to siblings)
        *labels("competitive_position", [
            ((gap <= th.price_dominant) & (impact == "Very Positive"), L.DOMINANT),
            ((gap <= th.price_advantage) & impact.isin(*POSITIVE_IMPACT), L.STRONG_ADVANTAGE),
            (gap.between(th.parity_low, th.parity_high), L.PARITY),
            (gap >= th.price_disadvantage, L.DISADVANTAGE),
        ], L.NEUTRAL),
        *labels("promotional_environment", [
            ((flag == "TRUE") & (gap >= 0), L.PROMO_PRESSURE),
            (flag == "TRUE", L.PROMO_ACTIVITY),
        ], L.STANDARD_ENVIRONMENT),
        *labels("value_proposition", [
            ((quality == "Superior") & (gap <= 0), L.PREMIUM_VALUE),
            (quality == "Superior", L.QUALITY_ADVANTAGE),
            (quality == "Comparable", L.QUALITY_PARITY),
        ], L.QUALITY_OPPORTUNITY),
        *labels("brand_position_strength", [
            ((brand == "Premium") & (impact == "Very Positive"), L.BRAND_LEADER),
            (brand == "Premium", L.PREMIUM_POSITIONING),
            (brand == "Mid-tier", L.MIDTIER_POSITIONING),
        ], L.POSITION_DEVELOPMENT),
    )


def report_order(rows: DataFrame) -> list[Column]:
    # ORDER BY names resolve to the rounded output columns
    return [rows["tracking_date"].desc_nulls_last(), F.abs(rows["price_gap_pct"]).desc_nulls_last()]


def build(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW, thresholds: Thresholds = DEFAULT_THRESHOLDS,
          rank_mode: str = "two_pass", cut_detail: bool = True) -> SubjectPlan:
    return build_plan(SUBJECT, detail(facts, window), KEYS, segment_aggs, ranks(), project, report_order,
                      thresholds=thresholds, rank_mode=rank_mode, cut_detail=cut_detail)
