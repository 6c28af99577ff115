"""Promotional calendar planning (PC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, REFERENCE_WINDOW, DateWindow, Thresholds
from marketlens.functions import count_if, exact_sum, labels, shown
from marketlens.plans import label_text as L
from marketlens.sources.layout import month_predicate
from marketlens.plans.base import RankSpec, SubjectPlan, build_plan

SUBJECT = "promotional_calendar"
KEYS = ("target_market", "product_category")
DETAIL_COLUMNS = (
    "promo_id", "start_date", "end_date", "campaign_name", "target_market", "product_category",
    "discount_type", "discount_value", "min_purchase_usd", "target_audience", "expected_uplift_pct",
    "budget_usd", "channel", "seasonality_factor", "competitive_response",
)
ISO = "yyyy-MM-dd"


def parse_date(c: str | Column) -> Column:
    """Strict ISO date parse: text that is not a yyyy-MM-dd date fails the query, with ANSI on or off."""
    text = F.col(c) if isinstance(c, str) else c
    day = F.try_to_date(text, ISO)
    bad = F.raise_error(F.concat(F.lit("not a yyyy-MM-dd date: "), text)).cast("date")
    return F.when(text.isNotNull() & day.isNull(), bad).otherwise(day)


def detail(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW, iso_dates: bool = False) -> DataFrame:
    """Promotions starting on or after ``window.start``; the window's end is ignored, as in the reference.

    ``iso_dates=True`` adds the equivalent text comparison ``start_date >= 'yyyy-mm-dd'``,
    which Parquet can skip row groups on; it is exact only when every start date
    is well-formed ISO text, so it is off by default.
    """
    start = parse_date("start_date")
    months = month_predicate(facts, SUBJECT, window.start)  # partition pruning, if laid out
    if months is not None:
        facts = facts.where(months)
    out = facts.select(*DETAIL_COLUMNS)
    if iso_dates:
        out = out.where(F.col("start_date") >= F.lit(window.start.isoformat()))
    return out.where(start >= F.lit(window.start)).withColumn(
        "campaign_duration_days", F.datediff(parse_date("end_date"), start).cast("bigint"))


def aggregate(rows: DataFrame, th: Thresholds) -> DataFrame:
    """The rollup in two steps: per (keys, channel, audience) first, so that the two distinct
    counts look at that small table and not at three copies of every detail row."""
    parts = ("channel", "target_audience")
    uplift = F.col("expected_uplift_pct")
    means = {"avg_expected_uplift": uplift, "avg_discount_value": F.col("discount_value"),
             "avg_campaign_duration": F.col("campaign_duration_days")}
    small = rows.groupBy(*KEYS, *parts).agg(
        F.count(F.lit(1)).alias("planned_campaigns"),
        exact_sum("budget_usd").alias("total_market_budget"),
        *[exact_sum(c).alias(f"{name}_sum") for name, c in means.items()],
        *[F.count(c).alias(f"{name}_n") for name, c in means.items()],
        count_if(F.col("competitive_response") == "High").alias("high_competition_campaigns"),
        count_if(uplift >= th.uplift_excellent).alias("high_impact_campaigns"),
        F.max(uplift).alias("max_expected_uplift"),
        F.min("budget_usd").alias("min_campaign_budget"),
        F.max("budget_usd").alias("max_campaign_budget"))
    total = lambda c: F.sum(c).alias(c)
    return small.groupBy(*KEYS).agg(
        total("planned_campaigns"), exact_sum("total_market_budget").alias("total_market_budget"),
        *[(exact_sum(f"{name}_sum") / F.nullif(F.sum(f"{name}_n"), F.lit(0))).alias(name) for name in means],
        total("high_competition_campaigns"), total("high_impact_campaigns"),
        F.count_distinct("channel").alias("channels_utilized"),
        F.count_distinct("target_audience").alias("audience_segments"),
        F.max("max_expected_uplift").alias("max_expected_uplift"),
        F.min("min_campaign_budget").alias("min_campaign_budget"),
        F.max("max_campaign_budget").alias("max_campaign_budget"))


def ranks() -> list[RankSpec]:
    return [
        RankSpec("impact_efficiency_rank", [("expected_uplift_pct", False), ("budget_usd", True)]),
        RankSpec("market_priority_rank", [("expected_uplift_pct", False)], ["target_market"]),
    ]


def segment_view(segments: DataFrame) -> DataFrame:
    return segments.select(
        *KEYS, "planned_campaigns",
        F.round("total_market_budget", 2).alias("market_total_budget"),
        shown("avg_expected_uplift", 1).alias("market_avg_expected_uplift"),
        shown("avg_discount_value", 1).alias("market_avg_discount"),
        shown("avg_campaign_duration", 0).alias("market_avg_duration_days"),
        "high_competition_campaigns", "high_impact_campaigns", "channels_utilized", "audience_segments",
        F.round("max_expected_uplift", 1).alias("market_max_uplift"),
        F.round("min_campaign_budget", 2).alias("market_min_budget"),
        F.round("max_campaign_budget", 2).alias("market_max_budget"),
    )


def project(j: DataFrame, th: Thresholds, *more: Column) -> DataFrame:
    uplift, budget = F.col("expected_uplift_pct"), F.col("budget_usd")
    response, dtype, dvalue = F.col("competitive_response"), F.col("discount_type"), F.col("discount_value")
    days = F.col("campaign_duration_days")
    return j.select(
        *more,
        *DETAIL_COLUMNS, "campaign_duration_days", "planned_campaigns",
        F.round("total_market_budget", 2).alias("market_total_budget"),
        shown("avg_expected_uplift", 1).alias("market_avg_expected_uplift"),
        shown("avg_discount_value", 1).alias("market_avg_discount"),
        shown("avg_campaign_duration", 0).alias("market_avg_duration_days"),
        "high_competition_campaigns", "high_impact_campaigns", "channels_utilized", "audience_segments",
        F.round("max_expected_uplift", 1).alias("market_max_uplift"),
        F.round("min_campaign_budget", 2).alias("market_min_budget"),
        F.round("max_campaign_budget", 2).alias("market_max_budget"),
        "impact_efficiency_rank", "market_priority_rank",
        *labels("campaign_priority_tier", [
            ((uplift >= th.uplift_excellent) & (budget <= th.low_cost_budget), L.HIGH_IMPACT_LOW_COST),
            (uplift >= th.uplift_excellent, L.HIGH_IMPACT),
            (uplift >= th.uplift_good, L.GOOD_IMPACT),
            (uplift >= th.uplift_moderate, L.MODERATE_IMPACT),
        ], L.LOW_IMPACT),
        *labels("competitive_intensity", [
            ((response == "High") & (uplift >= th.battleground_uplift), L.BATTLEGROUND),
            (response == "High", L.HIGH_RESPONSE),
            (response == "Medium", L.MODERATE_COMPETITION),
        ], L.LOW_PRESSURE),
        *labels("discount_strategy", [
            ((dtype == "Percentage") & (dvalue >= th.deep_discount_pct), L.DEEP_DISCOUNT),
            ((dtype == "Fixed Amount") & (dvalue >= th.high_value_discount), L.HIGH_VALUE_DISCOUNT),
            (dvalue >= th.standard_discount, L.STANDARD_DISCOUNT),
        ], L.PREMIUM_PRICING),
        *labels("budget_scale", [
            (budget >= th.budget_major, L.BUDGET_MAJOR),
            (budget >= th.budget_significant, L.BUDGET_SIGNIFICANT),
            (budget >= th.budget_standard, L.BUDGET_STANDARD),
        ], L.BUDGET_LIMITED),
        *labels("duration_strategy", [
            (days >= th.duration_extended, L.DURATION_EXTENDED),
            (days >= th.duration_standard, L.DURATION_STANDARD),
            (days >= th.duration_short, L.DURATION_SHORT),
        ], L.DURATION_FLASH),
    )


def report_order(rows: DataFrame) -> list[Column]:
    return [parse_date(rows["start_date"]).asc_nulls_first(), rows["expected_uplift_pct"].desc_nulls_last()]


def build(facts: DataFrame, window: DateWindow = REFERENCE_WINDOW, thresholds: Thresholds = DEFAULT_THRESHOLDS,
          rank_mode: str = "two_pass", cut_detail: bool = True, iso_dates: bool = False) -> SubjectPlan:
    return build_plan(SUBJECT, detail(facts, window, iso_dates), KEYS, None, ranks(), project,
                      report_order, thresholds=thresholds, rank_mode=rank_mode, cut_detail=cut_detail,
                      aggregate=lambda rows: aggregate(rows, thresholds))
