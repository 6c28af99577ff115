"""Price optimisation and elasticity (PE)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, REFERENCE_WINDOW, DateWindow, Thresholds
from marketlens.functions import count_if, exact_avg, labels, shown
from marketlens.plans import label_text as L
from marketlens.sources.layout import month_predicate
from marketlens.plans.base import RankSpec, SubjectPlan, build_plan

SUBJECT = "price_elasticity"
KEYS = ("market", "product_category", "customer_segment")
DETAIL_COLUMNS = (
    "analysis_date", "product_category", "market", "price_point_usd", "demand_quantity",
    "elasticity_coefficient", "customer_segment", "sensitivity_level", "optimal_price_usd",
    "revenue_impact_pct", "margin_impact_pct", "recommendation",
)
INCREASE, DECREASE, MAINTAIN = "Increase Price", "Decrease Price", "Maintain Price"


def detail(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW) -> DataFrame:
    months = month_predicate(facts, SUBJECT, window.start, window.end)  # partition pruning, if laid out
    if months is not None:
        facts = facts.where(months)
    return facts.select(*DETAIL_COLUMNS).where(window.contains(F.col("analysis_date")))


def segment_aggs(th: Thresholds) -> list[Column]:
    rec = F.col("recommendation")
    return [
        exact_avg("elasticity_coefficient").alias("avg_elasticity_coefficient"),
        F.count(F.lit(1)).alias("price_points_tested"),
        exact_avg("revenue_impact_pct").alias("avg_revenue_impact_pct"),
        exact_avg("margin_impact_pct").alias("avg_margin_impact_pct"),
        count_if(rec == INCREASE).alias("price_increase_recommendations"),
        count_if(rec == DECREASE).alias("price_decrease_recommendations"),
        count_if(rec == MAINTAIN).alias("maintain_price_recommendations"),
        exact_avg("optimal_price_usd").alias("avg_optimal_price"),
        F.max("revenue_impact_pct").alias("max_revenue_impact"),
        F.min("revenue_impact_pct").alias("min_revenue_impact"),
    ]


def ranks() -> list[RankSpec]:
    return [
        RankSpec("revenue_impact_rank", [(F.abs(F.col("revenue_impact_pct")), False)]),
        RankSpec("market_sensitivity_rank", [("elasticity_coefficient", False)], ["market"]),
    ]


def segment_view(segments: DataFrame) -> DataFrame:
    return segments.select(
        *KEYS,
        shown("avg_elasticity_coefficient", 2).alias("segment_avg_elasticity"),
        "price_points_tested",
        shown("avg_revenue_impact_pct", 1).alias("segment_avg_revenue_impact"),
        shown("avg_margin_impact_pct", 1).alias("segment_avg_margin_impact"),
        "price_increase_recommendations", "price_decrease_recommendations", "maintain_price_recommendations",
        shown("avg_optimal_price", 2).alias("segment_avg_optimal_price"),
        F.round("max_revenue_impact", 1).alias("segment_max_revenue_impact"),
        F.round("min_revenue_impact", 1).alias("segment_min_revenue_impact"),
    )


def project(j: DataFrame, th: Thresholds, *more: Column) -> DataFrame:
    e, impact, rec = F.col("elasticity_coefficient"), F.col("revenue_impact_pct"), F.col("recommendation")
    optimal, price = F.col("optimal_price_usd"), F.col("price_point_usd")
    return j.select(
        *more,
        "analysis_date", "product_category", "market", "customer_segment", "price_point_usd",
        "demand_quantity",
        F.round(e, 2).alias("elasticity_coefficient"),
        "sensitivity_level", "optimal_price_usd",
        F.round(impact, 1).alias("revenue_impact_pct"),
        F.round("margin_impact_pct", 1).alias("margin_impact_pct"),
        "recommendation",
        shown("avg_elasticity_coefficient", 2).alias("segment_avg_elasticity"),
        "price_points_tested",
        shown("avg_revenue_impact_pct", 1).alias("segment_avg_revenue_impact"),
        shown("avg_margin_impact_pct", 1).alias("segment_avg_margin_impact"),
        "price_increase_recommendations", "price_decrease_recommendations", "maintain_price_recommendations",
        shown("avg_optimal_price", 2).alias("segment_avg_optimal_price"),
        F.round("max_revenue_impact", 1).alias("segment_max_revenue_impact"),
        F.round("min_revenue_impact", 1).alias("segment_min_revenue_impact"),
        "revenue_impact_rank", "market_sensitivity_rank",
        *labels("sensitivity_classification", [
            (e >= th.elasticity_high, L.SENSITIVITY_HIGH),
            (e >= th.elasticity_low, L.SENSITIVITY_MODERATE),
        ], L.SENSITIVITY_LOW),
        *labels("pricing_strategy", [
            ((rec == INCREASE) & (impact > th.increase_strong_impact), L.STRONG_INCREASE),
            (rec == INCREASE, L.INCREASE),
            ((rec == DECREASE) & (impact > th.decrease_strategic_impact), L.STRATEGIC_DECREASE),
            (rec == DECREASE, L.DECREASE),
        ], L.MAINTAIN),
        *labels("revenue_opportunity_level", [
            (F.abs(impact) >= th.impact_high, L.IMPACT_HIGH),
            (F.abs(impact) >= th.impact_significant, L.IMPACT_SIGNIFICANT),
            (F.abs(impact) >= th.impact_moderate, L.IMPACT_MODERATE),
        ], L.IMPACT_MINIMAL),
        *labels("price_optimization_status", [
            (optimal > price * th.underpriced_factor, L.UNDER_PRICED),
            (optimal < price * th.overpriced_factor, L.OVER_PRICED),
        ], L.OPTIMALLY_PRICED),
    )


def report_order(rows: DataFrame) -> list[Column]:
    return [F.abs(rows["revenue_impact_pct"]).desc_nulls_last(), rows["elasticity_coefficient"].desc_nulls_last()]


def build(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW, thresholds: Thresholds = DEFAULT_THRESHOLDS,
          rank_mode: str = "two_pass", cut_detail: bool = True) -> SubjectPlan:
    return build_plan(SUBJECT, detail(facts, window), KEYS, segment_aggs, ranks(), project, report_order,
                      thresholds=thresholds, rank_mode=rank_mode, cut_detail=cut_detail)
