"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each reads the driver's base tables from ``sf_dir`` (whole tables; the report's
date window is the only filter) and returns a DataFrame.  Building a ranked
report runs the small jobs that cut lineage (see ``operators.ranking``); the
returned DataFrame itself is lazy.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.config import REFERENCE_WINDOW, STUDY_WINDOW
from marketlens.plans import campaign, competitor, elasticity, intent, pricing_ext, promo, seasonal, supply
from marketlens.plans.insights import insight_rows, insights
from marketlens.plans.summary import summarize
from marketlens.session import checkpoint_root, remember
from marketlens.sources import derived
from marketlens.sources.tables import Tables
from marketlens.streaming import price_monitor

Query = Callable[[SparkSession, str], DataFrame]

# subject prefix -> (module, fact builder, columns kept by the `_ranks` view)
SUBJECTS = {
    "competitor": (competitor, derived.competitor_tracking,
                   ["tracking_date", "competitor", "product_category", "market", "price_gap_pct",
                    "price_competitiveness_rank", "overall_competitiveness_rank"]),
    "campaign": (campaign, derived.campaign_performance,
                 ["campaign_name", "campaign_type", "target_audience", "market_segment",
                  "roi_rank", "revenue_rank", "efficiency_rank"]),
    "elasticity": (elasticity, derived.price_elasticity,
                   ["analysis_date", "product_category", "market", "customer_segment",
                    "elasticity_coefficient", "revenue_impact_pct", "revenue_impact_rank",
                    "market_sensitivity_rank"]),
    "promo": (promo, derived.promotional_calendar,
              ["promo_id", "target_market", "product_category", "expected_uplift_pct", "budget_usd",
               "impact_efficiency_rank", "market_priority_rank"]),
}


_OPENED: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Base tables of a folder, opened once per session (schemas read once)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPENED:
        _OPENED[key] = Tables.parquet(spark, sf_dir)
    return _OPENED[key]


_FACTS: dict[tuple[str, str, str], DataFrame] = {}


def facts_of(prefix: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject's report table over a folder: a lazy plan, defined once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, prefix)
    if key not in _FACTS:
        _FACTS[key] = SUBJECTS[prefix][1](tables(spark, sf_dir))
    return _FACTS[key]


def subject_plan(prefix: str, spark: SparkSession, sf_dir: str, **options):
    """The subject's plan over the driver's data, in the 1998 study window by default."""
    module = SUBJECTS[prefix][0]
    options.setdefault("window", STUDY_WINDOW)
    return module.build(facts_of(prefix, spark, sf_dir), **options)


def _subject_queries(prefix: str) -> dict[str, Query]:
    module, _, rank_cols = SUBJECTS[prefix]
    return {
        f"{prefix}_report": lambda spark, d: subject_plan(prefix, spark, d).report(100),
        f"{prefix}_labels": lambda spark, d: subject_plan(prefix, spark, d).rows,
        f"{prefix}_ranks": lambda spark, d: subject_plan(prefix, spark, d).ranked.select(*rank_cols),
        f"{prefix}_segments": lambda spark, d: module.segment_view(subject_plan(prefix, spark, d).segments),
        # scope 'full': every labelled row; scope 'top_n': the rows of the report (the reference's scope)
        f"{prefix}_summary": lambda spark, d: summarize(subject_plan(prefix, spark, d).alone, module.SUBJECT),
        f"{prefix}_insights": lambda spark, d: insights(insight_rows(subject_plan(prefix, spark, d)), module.SUBJECT),
        f"{prefix}_report_summary":
            lambda spark, d: summarize(subject_plan(prefix, spark, d).top(100), module.SUBJECT),
        f"{prefix}_report_insights":
            lambda spark, d: insights(subject_plan(prefix, spark, d).top(100), module.SUBJECT),
    }


QUERIES: dict[str, Query] = {}
for _prefix in SUBJECTS:
    QUERIES.update(_subject_queries(_prefix))

# The reference's own two days (the library default) once, as the empty-result case.
QUERIES.update({
    "competitor_report_reference_window":
        lambda spark, d: subject_plan("competitor", spark, d, window=REFERENCE_WINDOW).report(100),
    "competitor_insights_reference_window":
        lambda spark, d: insights(subject_plan("competitor", spark, d, window=REFERENCE_WINDOW).top(100),
                                  competitor.SUBJECT),
})


def _written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1: the report of a request by alias, written by the executors and read back."""
    from marketlens.api import analyze, read_report

    folder = f"{checkpoint_root(spark)}/written-report-{uuid.uuid4().hex}"
    remember(folder)
    analyze(tables(spark, sf_dir), query_type="competitor_analysis", limit=9999, window=STUDY_WINDOW).write(path=folder)
    return read_report(spark, folder)


QUERIES["competitor_report_written"] = _written_report


def _routed(spark, sf_dir, mode="first_match"):
    questions = intent.conversation_questions(tables(spark, sf_dir)["conversations"])
    return intent.route_requests(questions, mode=mode).select("conv_id", "turn", "intent")


QUERIES.update({
    "intent_routing": lambda spark, d: _routed(spark, d),
    "intent_routing_score": lambda spark, d: _routed(spark, d, "score"),
    "request_mix": lambda spark, d: intent.request_mix(_routed(spark, d)),
    # explicit names, aliases, an unknown name, limits, and texts for all four intents
    "request_resolution": lambda spark, d: intent.route_requests(
        intent.varied_requests(tables(spark, d)["conversations"]), strict=False).select(
            "conv_id", "turn", "query_type", "intent", "row_limit"),
})


# ---- Tier B (definitions of our own; see plans/supply.py and plans/pricing_ext.py)


def _tracking(spark, d):
    return facts_of("competitor", spark, d)


def _all_parts(spark, d):
    return tables(spark, d)["part"].select("p_partkey")


def _type_capacity(spark, d):
    """A capacity table: 40 units a month for each part of a type whose size is even (so some types may have none)."""
    even = tables(spark, d)["part"].where("p_size % 2 = 0")
    return even.groupBy(F.col("p_type").alias("part_type")).agg((F.count(F.lit(1)) * 40).alias("units"))


QUERIES.update({
    "tb_quality_trend": lambda spark, d: supply.quality_trend(tables(spark, d)),
    "tb_delivery_performance": lambda spark, d: supply.delivery_performance(tables(spark, d)),
    "tb_budget_variance": lambda spark, d: supply.budget_variance(tables(spark, d)),
    "tb_supplier_scorecard": lambda spark, d: supply.supplier_scorecard(tables(spark, d)),
    "tb_shipping_cost": lambda spark, d: supply.shipping_cost(tables(spark, d)),
    "tb_production_plan": lambda spark, d: supply.production_plan(tables(spark, d)),
    "tb_production_plan_given": lambda spark, d: supply.production_plan(tables(spark, d), _type_capacity(spark, d)),
    "tb_capacity_plan": lambda spark, d: supply.capacity_plan(tables(spark, d)),
    "tb_price_monitor": lambda spark, d: pricing_ext.price_monitor(_tracking(spark, d)),
    "tb_market_entries": lambda spark, d: pricing_ext.market_entries(_tracking(spark, d)),
    "tb_market_forecast": lambda spark, d: pricing_ext.market_forecast(_tracking(spark, d)),
    "tb_seasonal_forecast": lambda spark, d: seasonal.seasonal_forecast(_tracking(spark, d)),
    "tb_price_rules": lambda spark, d: pricing_ext.apply_price_rules(tables(spark, d)),
    "tb_price_rule_table": lambda spark, d: pricing_ext.apply_price_rule_table(
        tables(spark, d)["part"], pricing_ext.rules_frame(spark)),
    "tb_price_rule_table_large": lambda spark, d: pricing_ext.apply_price_rule_table(
        tables(spark, d)["part"], pricing_ext.rules_from_parts(tables(spark, d)["part"])),
    "tb_market_rules": lambda spark, d: pricing_ext.apply_price_rule_table(
        pricing_ext.market_conditions(tables(spark, d)), pricing_ext.market_rules(tables(spark, d))),
    "tb_elasticity_curves": lambda spark, d: pricing_ext.elasticity_curves(tables(spark, d)),
    "tb_optimal_prices": lambda spark, d: pricing_ext.optimal_prices(tables(spark, d)),
    "tb_brand_share": lambda spark, d: pricing_ext.brand_share(tables(spark, d)),
    "tb_product_competitor_prices":
        lambda spark, d: pricing_ext.competitor_prices_for(_all_parts(spark, d), tables(spark, d)),
    "tb_product_supplier_performance":
        lambda spark, d: pricing_ext.supplier_performance_for(_all_parts(spark, d), tables(spark, d)),
    "tb_product_optimal_price":
        lambda spark, d: pricing_ext.optimal_price_for(_all_parts(spark, d), tables(spark, d)),
    "tb_brand_rollup": lambda spark, d: pricing_ext.brand_rollup(pricing_ext.brand_lines(tables(spark, d))),
})


# ---- TB-14: the live monitor, run over the events table (a file or a folder) with availableNow

QUERIES["tb_price_stream"] = lambda spark, d: price_monitor.run_available(spark, f"{d}/events.parquet")
