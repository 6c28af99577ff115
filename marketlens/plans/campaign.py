"""Marketing campaign ROI and performance (CP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, REFERENCE_WINDOW, DateWindow, Thresholds
from marketlens.functions import exact_avg, exact_sum, labels, ratio, shown
from marketlens.plans import label_text as L
from marketlens.sources.layout import month_predicate
from marketlens.plans.base import RankSpec, SubjectPlan, build_plan

SUBJECT = "campaign_performance"
KEYS = ("campaign_type", "target_audience", "market_segment")
DETAIL_COLUMNS = (
    "campaign_date", "campaign_name", "campaign_type", "target_audience", "discount_pct",
    "original_price_usd", "campaign_price_usd", "units_sold", "revenue_generated", "campaign_cost",
    "roi_pct", "customer_acquisition", "repeat_purchase_rate", "market_segment",
)


def detail(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW) -> DataFrame:
    months = month_predicate(facts, SUBJECT, window.start, window.end)  # partition pruning, if laid out
    if months is not None:
        facts = facts.where(months)
    return facts.select(*DETAIL_COLUMNS).where(window.contains(F.col("campaign_date")))


def segment_aggs(th: Thresholds) -> list[Column]:
    revenue, cost = exact_sum("revenue_generated"), exact_sum("campaign_cost")
    return [
        F.count(F.lit(1)).alias("campaigns_executed"),
        exact_avg("roi_pct").alias("avg_roi_pct"),
        exact_avg("discount_pct").alias("avg_discount_pct"),
        revenue.alias("total_revenue_generated"),
        cost.alias("total_campaign_cost"),
        F.sum("customer_acquisition").alias("total_new_customers"),
        exact_avg("repeat_purchase_rate").alias("avg_repeat_purchase_rate"),
        F.sum("units_sold").alias("total_units_sold"),
        ratio(revenue, cost).alias("revenue_cost_ratio"),
        # the reference's name; the value is acquisitions per 1000 USD of cost
        (ratio(F.sum("customer_acquisition"), cost) * F.lit(1000)).alias("cost_per_acquisition_usd"),
        # D4: the same value under an honest name, and the true cost per acquisition
        (ratio(F.sum("customer_acquisition"), cost) * F.lit(1000)).alias("acquisitions_per_1000_usd"),
        ratio(cost, F.sum("customer_acquisition")).alias("true_cost_per_acquisition"),
    ]


def ranks() -> list[RankSpec]:
    # Ranked over detail rows by a segment value: rank the rollup, each segment
    # weighted by its row count (every row of a segment shares the value).
    return [
        RankSpec("roi_rank", [("avg_roi_pct", False)], on_segments=True),
        RankSpec("revenue_rank", [("total_revenue_generated", False)], on_segments=True),
        RankSpec("efficiency_rank", [("cost_per_acquisition_usd", True)], on_segments=True),
    ]


def segment_view(segments: DataFrame) -> DataFrame:
    return segments.select(
        *KEYS, "campaigns_executed",
        shown("avg_roi_pct", 1).alias("segment_avg_roi"),
        shown("avg_discount_pct", 1).alias("segment_avg_discount"),
        F.round("total_revenue_generated", 2).alias("segment_total_revenue"),
        F.round("total_campaign_cost", 2).alias("segment_total_cost"),
        "total_new_customers",
        shown("avg_repeat_purchase_rate", 1).alias("segment_avg_repeat_rate"),
        "total_units_sold",
        F.round("revenue_cost_ratio", 2).alias("segment_revenue_cost_ratio"),
        F.round("cost_per_acquisition_usd", 2).alias("segment_cost_per_acquisition"),
        F.round("acquisitions_per_1000_usd", 2).alias("segment_acquisitions_per_1000_usd"),
        F.round("true_cost_per_acquisition", 2).alias("segment_true_cost_per_acquisition"),
    )


def project(j: DataFrame, th: Thresholds, *more: Column) -> DataFrame:
    roi, disc = F.col("roi_pct"), F.col("discount_pct")
    repeat, acq = F.col("repeat_purchase_rate"), F.col("customer_acquisition")
    seg_cpa = F.round("cost_per_acquisition_usd", 2)
    return j.select(
        *more,
        "campaign_date", "campaign_name", "campaign_type", "target_audience", "market_segment",
        "discount_pct", "original_price_usd", "campaign_price_usd", "units_sold",
        F.round("revenue_generated", 2).alias("revenue_generated"),
        F.round("campaign_cost", 2).alias("campaign_cost"),
        F.round(roi, 1).alias("roi_pct"),
        "customer_acquisition",
        F.round(repeat, 1).alias("repeat_purchase_rate"),
        "campaigns_executed",
        shown("avg_roi_pct", 1).alias("segment_avg_roi"),
        shown("avg_discount_pct", 1).alias("segment_avg_discount"),
        F.round("total_revenue_generated", 2).alias("segment_total_revenue"),
        F.round("total_campaign_cost", 2).alias("segment_total_cost"),
        "total_new_customers",
        shown("avg_repeat_purchase_rate", 1).alias("segment_avg_repeat_rate"),
        "total_units_sold",
        F.round("revenue_cost_ratio", 2).alias("segment_revenue_cost_ratio"),
        seg_cpa.alias("segment_cost_per_acquisition"),
        F.round("acquisitions_per_1000_usd", 2).alias("segment_acquisitions_per_1000_usd"),
        F.round("true_cost_per_acquisition", 2).alias("segment_true_cost_per_acquisition"),
        "roi_rank", "revenue_rank", "efficiency_rank",
        *labels("campaign_performance_tier", [
            (roi >= th.roi_excellent, L.ROI_EXCELLENT),
            (roi >= th.roi_good, L.ROI_GOOD),
            (roi >= th.roi_average, L.ROI_AVERAGE),
        ], L.ROI_POOR),
        *labels("discount_efficiency", [
            ((disc >= th.discount_high) & (roi >= th.roi_good), L.HIGH_DISCOUNT_HIGH_RETURN),
            (disc >= th.discount_high, L.HIGH_DISCOUNT_LOW_RETURN),
            (roi >= th.roi_good, L.EFFICIENT_CAMPAIGN),
        ], L.STANDARD_CAMPAIGN),
        *labels("retention_performance", [
            (repeat >= th.repeat_excellent, L.RETENTION_EXCELLENT),
            (repeat >= th.repeat_good, L.RETENTION_GOOD),
            (repeat >= th.repeat_standard, L.RETENTION_STANDARD),
        ], L.RETENTION_LOW),
        *labels("acquisition_effectiveness", [
            # the guard reads the segment value *rounded*, as the reference's CTE exposes it
            ((acq >= th.acquisition_efficient) & (seg_cpa <= th.cost_per_acquisition_max),
             L.ACQUISITION_EFFICIENT),
            (acq >= th.acquisition_good, L.ACQUISITION_GOOD),
            (acq >= th.acquisition_standard, L.ACQUISITION_STANDARD),
        ], L.ACQUISITION_LOW),
    )


def report_order(rows: DataFrame) -> list[Column]:
    return [rows["roi_pct"].desc_nulls_last(), rows["revenue_generated"].desc_nulls_last()]


def build(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW, thresholds: Thresholds = DEFAULT_THRESHOLDS,
          rank_mode: str = "two_pass", cut_detail: bool = True) -> SubjectPlan:
    return build_plan(SUBJECT, detail(facts, window), KEYS, segment_aggs, ranks(), project, report_order,
                      segment_weight="campaigns_executed", thresholds=thresholds, rank_mode=rank_mode,
                      cut_detail=cut_detail)
