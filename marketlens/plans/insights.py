"""Insight, recommendation and alert rules over a report's rows.

The reference scans its returned rows once per rule.  Here one aggregation
computes every count a subject's rules need (partial aggregation on each
partition, then a single tiny merge), and the rules become an array of structs
over that one row, exploded and filtered on their conditions.  The caps of the
reference (10 insights, 5 recommendations, 5 alerts, in emission order) are a
``row_number`` over at most a dozen rows.

Output columns: kind, seq, code, metric, detail.  ``messages()`` adds the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, Thresholds
from marketlens.functions import code_of, count_if, exact_avg, exact_sum
from marketlens.plans import label_text as L

INSIGHT, RECOMMENDATION, ALERT = "insight", "recommendation", "alert"
CAPS = {INSIGHT: 10, RECOMMENDATION: 5, ALERT: 5}


@dataclass(frozen=True)
class Rule:
    kind: str
    seq: int
    code: Callable[[], Column] | str
    metric: Callable[[], Column]
    when: Callable[[], Column]
    detail: Callable[[], Column] | None = None


def _c(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _positive(name: str) -> Callable[[], Column]:
    return lambda: F.col(name) > 0


def _count_rule(kind: str, seq: int, code: str, stat: str) -> Rule:
    return Rule(kind, seq, code, _c(stat), _positive(stat))


def _is(column: str, *texts: str) -> Column:
    """Whether a row carries one of the labels, by its plain code."""
    return F.col(f"{column}_code").isin(*[code_of(t) for t in texts])


# ---- per-subject statistics (one aggregation) and rules ----------------------

def _competitor_stats(th: Thresholds) -> list[Column]:
    gap = F.col("price_gap_pct")
    return [
        count_if(_is("competitive_position", L.STRONG_ADVANTAGE)).alias("strong"),
        count_if(_is("competitive_position", L.DISADVANTAGE)).alias("disadvantage"),
        count_if(_is("value_proposition", L.PREMIUM_VALUE)).alias("premium_value"),
        count_if(_is("promotional_environment", L.PROMO_PRESSURE)).alias("promo_pressure"),
        F.count(gap).alias("gap_n"),
        exact_avg(gap).alias("gap_mean"),
        F.lit(th.insight_gap_band).alias("gap_band"),
    ]


def _gap_code() -> Column:
    m, band = F.col("gap_mean"), F.col("gap_band")
    return F.when(m < -band, "avg_gap_advantage").when(m > band, "avg_gap_disadvantage").otherwise("avg_gap_parity")


COMPETITOR_RULES = [
    _count_rule(INSIGHT, 1, "strong_price_advantage", "strong"),
    _count_rule(ALERT, 1, "price_disadvantage", "disadvantage"),
    _count_rule(RECOMMENDATION, 1, "review_price_disadvantage", "disadvantage"),
    _count_rule(INSIGHT, 2, "premium_value_proposition", "premium_value"),
    _count_rule(ALERT, 2, "competitor_promo_pressure", "promo_pressure"),
    _count_rule(RECOMMENDATION, 2, "respond_to_competitor_promos", "promo_pressure"),
    Rule(INSIGHT, 3, _gap_code, lambda: F.round("gap_mean", 1), _positive("gap_n")),
]


def _campaign_stats(th: Thresholds) -> list[Column]:
    excellent = _is("campaign_performance_tier", L.ROI_EXCELLENT)
    roi, revenue = F.col("roi_pct"), F.col("revenue_generated")
    # first Excellent row in report order: roi desc, revenue desc, then date and name
    order_key = F.struct(
        F.coalesce(-roi, F.lit(float("inf"))).alias("a"),
        F.coalesce(-revenue, F.lit(float("inf"))).alias("b"),
        F.col("campaign_date").alias("c"), F.col("campaign_name").alias("d"))
    return [
        count_if(excellent).alias("excellent"),
        F.max(F.when(excellent, roi)).alias("best_roi"),
        F.min_by(F.col("campaign_name"), F.when(excellent, order_key)).alias("best_campaign"),
        count_if(_is("campaign_performance_tier", L.ROI_POOR)).alias("poor"),
        count_if(_is("acquisition_effectiveness", L.ACQUISITION_EFFICIENT)).alias("efficient_acquisition"),
        count_if(_is("retention_performance", L.RETENTION_EXCELLENT)).alias("excellent_retention"),
        exact_sum("revenue_generated").alias("revenue_total"),
        exact_sum("campaign_cost").alias("cost_total"),
    ]


CAMPAIGN_RULES = [
    Rule(INSIGHT, 1, "top_campaign", _c("best_roi"), _positive("excellent"), _c("best_campaign")),
    _count_rule(ALERT, 1, "poor_campaigns", "poor"),
    _count_rule(RECOMMENDATION, 1, "optimize_low_roi_types", "poor"),
    _count_rule(INSIGHT, 2, "efficient_acquisition", "efficient_acquisition"),
    _count_rule(INSIGHT, 3, "excellent_retention", "excellent_retention"),
    Rule(INSIGHT, 4, "overall_roi",
         lambda: F.round((F.col("revenue_total") / F.col("cost_total") - 1) * 100, 1),
         _positive("cost_total")),
]


def _elasticity_stats(th: Thresholds) -> list[Column]:
    return [
        count_if(_is("pricing_strategy", L.STRONG_INCREASE)).alias("strong_increase"),
        count_if(_is("price_optimization_status", L.UNDER_PRICED)).alias("under_priced"),
        count_if(_is("revenue_opportunity_level", L.IMPACT_HIGH)).alias("high_impact"),
        count_if(_is("sensitivity_classification", L.SENSITIVITY_LOW)).alias("low_sensitivity"),
    ]


ELASTICITY_RULES = [
    _count_rule(INSIGHT, 1, "strong_increase_opportunity", "strong_increase"),
    _count_rule(RECOMMENDATION, 1, "pilot_price_increases", "strong_increase"),
    _count_rule(INSIGHT, 2, "under_priced", "under_priced"),
    _count_rule(RECOMMENDATION, 2, "optimize_under_priced", "under_priced"),
    _count_rule(INSIGHT, 3, "high_revenue_impact", "high_impact"),
    _count_rule(RECOMMENDATION, 3, "ab_test_high_impact", "high_impact"),
    _count_rule(INSIGHT, 4, "low_price_sensitivity", "low_sensitivity"),
    _count_rule(RECOMMENDATION, 4, "premium_pricing", "low_sensitivity"),
]


def _promo_stats(th: Thresholds) -> list[Column]:
    return [
        count_if(_is("campaign_priority_tier", L.HIGH_IMPACT_LOW_COST)).alias("high_impact_low_cost"),
        count_if(_is("campaign_priority_tier", L.HIGH_IMPACT, L.HIGH_IMPACT_LOW_COST)).alias("high_impact_total"),
        count_if(_is("competitive_intensity", L.BATTLEGROUND)).alias("battleground"),
        exact_sum("budget_usd").alias("budget_total"),
        count_if(_is("budget_scale", L.BUDGET_MAJOR)).alias("major"),
        count_if(_is("duration_strategy", L.DURATION_FLASH)).alias("flash"),
        count_if(_is("duration_strategy", L.DURATION_EXTENDED)).alias("extended"),
    ]


PROMO_RULES = [
    _count_rule(INSIGHT, 1, "high_impact_low_cost", "high_impact_low_cost"),
    _count_rule(RECOMMENDATION, 1, "execute_high_impact_low_cost", "high_impact_low_cost"),
    Rule(INSIGHT, 2, "high_impact_total", _c("high_impact_total"), lambda: F.lit(True)),
    _count_rule(ALERT, 1, "competitive_battleground", "battleground"),
    _count_rule(RECOMMENDATION, 2, "differentiate_battlegrounds", "battleground"),
    Rule(INSIGHT, 3, "total_budget", _c("budget_total"), lambda: F.lit(True)),
    _count_rule(INSIGHT, 4, "major_investments", "major"),
    _count_rule(INSIGHT, 5, "flash_campaigns", "flash"),
    _count_rule(INSIGHT, 6, "extended_campaigns", "extended"),
]

NO_DATA_RULES = [
    Rule(INSIGHT, 1, "no_data", lambda: F.lit(0.0), lambda: F.lit(True)),
    Rule(RECOMMENDATION, 1, "widen_criteria", lambda: F.lit(0.0), lambda: F.lit(True)),
]

SUBJECT_RULES = {
    "competitor_tracking": (_competitor_stats, COMPETITOR_RULES),
    "campaign_performance": (_campaign_stats, CAMPAIGN_RULES),
    "price_elasticity": (_elasticity_stats, ELASTICITY_RULES),
    "promotional_calendar": (_promo_stats, PROMO_RULES),
}


def insight_rows(plan) -> DataFrame:
    """The labelled rows that the subject's rules read: campaign rules need a label of the rollup, the others the detail alone."""
    return plan.labelled if plan.subject == "campaign_performance" else plan.alone


def _rule_struct(rule: Rule, gate: Column) -> Column:
    code = F.lit(rule.code) if isinstance(rule.code, str) else rule.code()
    detail = rule.detail() if rule.detail else F.lit(None)
    return F.struct(
        F.lit(rule.kind).alias("kind"), F.lit(rule.seq).alias("seq"), code.alias("code"),
        rule.metric().cast("double").alias("metric"), detail.cast("string").alias("detail"),
        (gate & F.coalesce(rule.when(), F.lit(False))).alias("keep"))


def insights(rows: DataFrame, subject: str, thresholds: Thresholds = DEFAULT_THRESHOLDS) -> DataFrame:
    """(kind, seq, code, metric, detail) rows, capped per kind in emission order."""
    stats_fn, rules = SUBJECT_RULES[subject]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *stats_fn(thresholds))
    has_rows = F.col("n") > 0
    structs = [_rule_struct(r, has_rows) for r in rules] + [_rule_struct(r, ~has_rows) for r in NO_DATA_RULES]
    fired = stats.select(F.explode(F.array(*structs)).alias("r")).select("r.*").where("keep").drop("keep")
    w = Window.partitionBy("kind").orderBy("seq")  # at most a dozen rows
    cap = F.when(F.col("kind") == INSIGHT, CAPS[INSIGHT]).when(
        F.col("kind") == RECOMMENDATION, CAPS[RECOMMENDATION]).otherwise(CAPS[ALERT])
    return fired.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
