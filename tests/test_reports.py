"""Inline edge rows (FIXTURES.md section 3) through the four report plans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlens.config import DateWindow, resolve_limit
from marketlens.plans import campaign, competitor, elasticity, promo
from marketlens.plans import label_text as L
from marketlens.plans.insights import insights
from marketlens.plans.intent import route
from marketlens.plans.summary import summarize
from marketlens.sources.schemas import (CAMPAIGN_PERFORMANCE, COMPETITOR_TRACKING, PRICE_ELASTICITY,
                                        PROMOTIONAL_CALENDAR)

D = dt.date(2024, 12, 14)
W = DateWindow.of("2024-12-14", "2024-12-15")
MODES = ["two_pass", "window"]


def ct_row(gap, impact="Neutral", flag="FALSE", quality="Inferior", brand="Value", market="EU", cat="A",
           comp="c1", day=D):
    return (day, comp, cat, market, 100.0, 100.0, gap, flag, quality, brand, impact)


@pytest.mark.parametrize("mode", MODES)
def test_competitor_thresholds_and_nulls(spark, mode):
    rows = [
        ct_row(-30.0, "Very Positive"), ct_row(-15.0, "Positive"), ct_row(-15.0, "Neutral"),
        ct_row(10.0), ct_row(12.0), ct_row(15.0), ct_row(15.1), ct_row(None),
        ct_row(0.0, market=None),  # NULL join key: dropped by the inner join-back
        ct_row(5.0, flag="true"), ct_row(5.0, flag="TRUE"), ct_row(-5.0, flag="TRUE"), ct_row(5.0, flag=None),
    ]
    facts = spark.createDataFrame(rows, COMPETITOR_TRACKING)
    plan = competitor.build(facts, window=W, rank_mode=mode)
    out = plan.rows.collect()
    assert len(out) == len(rows) - 1
    assert all(r.market is not None for r in out)
    by_gap = {}
    for r in out:
        by_gap.setdefault(r.price_gap_pct, set()).add(r.competitive_position)
    assert by_gap[-30.0] == {L.DOMINANT}
    assert by_gap[-15.0] == {L.STRONG_ADVANTAGE, L.PARITY}
    assert by_gap[10.0] == {L.PARITY} and by_gap[12.0] == {L.PARITY} and by_gap[15.0] == {L.PARITY}
    assert by_gap[15.1] == {L.DISADVANTAGE}
    assert by_gap[None] == {L.NEUTRAL}
    envs = sorted((r.promotion_flag or "", r.price_gap_pct, r.promotional_environment) for r in out
                  if r.price_gap_pct in (5.0, -5.0))
    assert envs == [("", 5.0, L.STANDARD_ENVIRONMENT), ("TRUE", -5.0, L.PROMO_ACTIVITY),
                    ("TRUE", 5.0, L.PROMO_PRESSURE), ("true", 5.0, L.STANDARD_ENVIRONMENT)]
    seg = plan.segments.collect()[0]
    assert seg.competitor_promotions_active == 2 and seg.price_advantages == 3
    # NULL gap ranks first ascending; ties share a rank and leave a gap
    ranks = sorted((r.overall_competitiveness_rank, r.price_gap_pct) for r in out)
    assert ranks[0] == (1, None)
    fives = [rk for rk, g in ranks if g in (5.0, -5.0)]
    assert len(set(fives)) == 1
    after = [rk for rk, g in ranks if g == 10.0][0]
    assert after == fives[0] + len(fives)


@pytest.mark.parametrize("mode", MODES)
def test_campaign_rounding_zero_cost_and_guard(spark, mode):
    def cp(name, roi, cost, acq, ctype="T1", rev=1000.0):
        return (D, name, ctype, "aud", 10.0, 100.0, 90.0, 5, rev, cost, roi, acq, 30.0, "EU")
    rows = [
        cp("a", 499.96, 2000.0, 100), cp("b", 500.0, 2000.0, 100),
        cp("z", 100.0, 0.0, 10, ctype="ZERO"),
        cp("g1", 300.0, 2000.0, 100, ctype="G50", rev=1.0),
        cp("g2", 300.0, 2000.0, 100, ctype="G5001", rev=1.0),
    ]
    facts = spark.createDataFrame(rows, CAMPAIGN_PERFORMANCE)
    plan = campaign.build(facts, window=W, rank_mode=mode)
    out = {r.campaign_name: r for r in plan.rows.collect()}
    assert out["a"].roi_pct == 500.0 and out["a"].campaign_performance_tier == L.ROI_GOOD
    assert out["b"].campaign_performance_tier == L.ROI_EXCELLENT
    assert out["z"].segment_revenue_cost_ratio is None and out["z"].segment_cost_per_acquisition is None
    assert out["z"].efficiency_rank == 1  # NULL first ascending
    # segment rank by segment value: all rows of segment T1 share roi_rank
    assert out["a"].roi_rank == out["b"].roi_rank


def test_campaign_acquisition_guard_reads_rounded_segment_value(spark):
    # segment acquisitions per 1000 USD: 100 / 2000 * 1000 = 50.0 -> efficient;
    # 100 / 1999.8 * 1000 = 50.005 -> rounds to 50.01 -> not efficient
    def cp(name, ctype, cost):
        return (D, name, ctype, "aud", 10.0, 100.0, 90.0, 5, 10.0, cost, 1.0, 100, 30.0, "EU")
    facts = spark.createDataFrame([cp("x", "S1", 2000.0), cp("y", "S2", 1999.8)], CAMPAIGN_PERFORMANCE)
    out = {r.campaign_name: r for r in campaign.build(facts, window=W).rows.collect()}
    assert out["x"].segment_cost_per_acquisition == 50.0
    assert out["x"].acquisition_effectiveness == L.ACQUISITION_EFFICIENT
    assert out["y"].segment_cost_per_acquisition == 50.01
    assert out["y"].acquisition_effectiveness == L.ACQUISITION_GOOD


def test_elasticity_labels(spark):
    def pe(e, impact, rec, optimal):
        return (D, "cat", "EU", 100.0, 10, e, "seg", "High", optimal, impact, 0.0, rec)
    rows = [pe(2.0, 6.0, "Increase Price", 111.0), pe(1.0, 5.0, "Increase Price", 89.0),
            pe(0.99, 11.0, "Decrease Price", 100.0), pe(0.5, -15.0, "Maintain Price", 110.0)]
    out = sorted(elasticity.build(spark.createDataFrame(rows, PRICE_ELASTICITY), window=W).rows.collect(),
                 key=lambda r: -r.elasticity_coefficient)
    assert [r.sensitivity_classification for r in out] == [
        L.SENSITIVITY_HIGH, L.SENSITIVITY_MODERATE, L.SENSITIVITY_LOW, L.SENSITIVITY_LOW]
    assert [r.pricing_strategy for r in out] == [L.STRONG_INCREASE, L.INCREASE, L.STRATEGIC_DECREASE, L.MAINTAIN]
    assert [r.price_optimization_status for r in out] == [
        L.UNDER_PRICED, L.OVER_PRICED, L.OPTIMALLY_PRICED, L.OPTIMALLY_PRICED]
    assert out[3].revenue_opportunity_level == L.IMPACT_HIGH


def pc_row(pid, start, end, uplift=35.0, budget=15000.0, response="High", dtype="Percentage", value=30.0):
    return (pid, start, end, "Promo", "EU", "cat", dtype, value, 0.0, "aud", uplift, budget, "Email", 1.0,
            response)


def test_promo_durations_and_priority(spark):
    rows = [pc_row("p7", "2024-12-14", "2024-12-21", uplift=40.0, budget=20000.0),
            pc_row("p14", "2024-12-15", "2024-12-29", uplift=40.0, budget=20000.01),
            pc_row("p30", "2025-01-01", "2025-01-31", uplift=20.0),
            pc_row("p6", "2024-12-20", "2024-12-26", uplift=30.0),
            pc_row("old", "2024-12-13", "2024-12-31")]
    plan = promo.build(spark.createDataFrame(rows, PROMOTIONAL_CALENDAR), window=W)
    out = {r.promo_id: r for r in plan.rows.collect()}
    assert "old" not in out  # open-ended start filter
    assert out["p7"].duration_strategy == L.DURATION_SHORT and out["p14"].duration_strategy == L.DURATION_STANDARD
    assert out["p30"].duration_strategy == L.DURATION_EXTENDED and out["p6"].duration_strategy == L.DURATION_FLASH
    assert out["p7"].campaign_priority_tier == L.HIGH_IMPACT_LOW_COST
    assert out["p14"].campaign_priority_tier == L.HIGH_IMPACT
    assert out["p7"].competitive_intensity == L.BATTLEGROUND
    # report order: parsed start date ascending
    assert [r.promo_id for r in plan.report(10).collect()] == ["p7", "p14", "p6", "p30"]


def test_promo_bad_date_text_fails(spark):
    rows = [pc_row("bad", "14/12/2024", "2024-12-20")]
    plan_rows = promo.build(spark.createDataFrame(rows, PROMOTIONAL_CALENDAR), window=W,
                            rank_mode="window").rows
    with pytest.raises(Exception):
        plan_rows.collect()


def test_empty_input_summary_and_insights(spark):
    facts = spark.createDataFrame([ct_row(1.0, day=dt.date(2020, 1, 1))], COMPETITOR_TRACKING)
    plan = competitor.build(facts, window=W)
    s = summarize(plan.report(100), "competitor_tracking").collect()[0]
    assert s.total_records == 0 and s.query_type is None and s.unique_markets is None
    got = sorted((r.kind, r.code) for r in insights(plan.rows, "competitor_tracking").collect())
    assert got == [("insight", "no_data"), ("recommendation", "widen_criteria")]


def test_competitor_insights_counts(spark):
    rows = [ct_row(-20.0, "Positive"), ct_row(-16.0, "Very Positive"), ct_row(20.0, flag="TRUE"),
            ct_row(-1.0, quality="Superior")]
    plan = competitor.build(spark.createDataFrame(rows, COMPETITOR_TRACKING), window=W)
    got = {(r.kind, r.code): r.metric for r in insights(plan.rows, "competitor_tracking").collect()}
    assert got[("insight", "strong_price_advantage")] == 2
    assert got[("alert", "price_disadvantage")] == 1
    assert got[("alert", "competitor_promo_pressure")] == 1
    assert got[("insight", "premium_value_proposition")] == 1
    assert got[("insight", "avg_gap_parity")] == -4.3  # mean -4.25, rounded half away from zero


@pytest.mark.parametrize("question,expected", [
    ("marketing campaign ROI", "competitor_tracking"),
    ("price elasticity", "competitor_tracking"),
    ("promotional calendar", "campaign_performance"),
    ("heroic effort", "campaign_performance"),
    ("demand sensitivity", "price_elasticity"),
    ("seasonal schedule", "promotional_calendar"),
    ("", "competitor_tracking"),
    (None, "competitor_tracking"),
    ("İndirim", "competitor_tracking"),
])
def test_routing_examples(question, expected):
    assert route(question) == expected


def test_routing_column_matches_python(spark):
    from marketlens.plans.intent import intent_of
    qs = ["marketing campaign ROI", "price elasticity", "promotional calendar", "heroic effort",
          "demand sensitivity", "seasonal schedule", "", None, "İndirim", "Bütçe planlama"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    got = [r.i for r in df.select(intent_of(df.q).alias("i")).collect()]
    assert got == [route(q) for q in qs]
    got = [r.i for r in df.select(intent_of(df.q, "score").alias("i")).collect()]
    from marketlens.plans.intent import detect
    assert got == [detect(q, "score") for q in qs]


def test_alias_and_unknown_types():
    assert route(query_type="campaign_analysis") == "campaign_performance"
    assert route(query_type="promotional_planning") == "promotional_calendar"
    with pytest.raises(ValueError):
        route(query_type="nonsense")
    assert route(query_type="nonsense", strict=False) == "competitor_tracking"


@pytest.mark.parametrize("limit,expected", [(0, 0), (1, 1), (100, 100), (500, 500), (501, 500), (None, 100)])
def test_limits(limit, expected):
    assert resolve_limit(limit) == expected


def test_negative_limit_rejected():
    with pytest.raises(ValueError):
        resolve_limit(-1)


def test_price_rule_table_agrees_with_the_case_chain(spark):
    from marketlens.plans import pricing_ext
    from marketlens.plans.registry import tables
    from tests.conftest import SMALL
    t = tables(spark, SMALL)
    chain = sorted(pricing_ext.apply_price_rules(t).collect())
    table = sorted(pricing_ext.apply_price_rule_table(t["part"], pricing_ext.rules_frame(spark)).collect())
    assert chain == table
    assert pricing_ext.apply_price_rule_table(t["part"].limit(0), pricing_ext.rules_frame(spark)).count() == 0
    plan = pricing_ext.apply_price_rule_table(t["part"], pricing_ext.rules_frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_route_requests_table(spark):
    from marketlens.plans.intent import request_mix, route_requests
    reqs = spark.createDataFrame([
        (1, "seasonal schedule", None, None),
        (2, "anything", "campaign_analysis", 600),
        (3, "demand", "", 5),
        (4, None, "nonsense", 10),
    ], "request_id bigint, question string, query_type string, limit int")
    lenient = {r.request_id: (r.intent, r.row_limit) for r in route_requests(reqs, strict=False).collect()}
    assert lenient == {1: ("promotional_calendar", 100), 2: ("campaign_performance", 500),
                       3: ("price_elasticity", 5), 4: ("competitor_tracking", 10)}
    with pytest.raises(Exception):
        route_requests(reqs).collect()  # strict: the unknown type fails the query
    neg = spark.createDataFrame([(5, "prices", None, -1)], reqs.schema)
    with pytest.raises(Exception):
        route_requests(neg).collect()
    mix = {r.intent: r.requests for r in request_mix(route_requests(reqs, strict=False)).collect()}
    assert sum(mix.values()) == 4


def test_exact_aggregates_follow_nan_and_infinity(spark):
    import math
    from marketlens.functions import exact_avg, exact_sum
    nan, inf = float("nan"), float("inf")
    rows = [("nan", 1.0), ("nan", nan), ("inf", 1.0), ("inf", inf), ("both", inf), ("both", -inf), ("none", None), ("some", None), ("some", 1e-12),
            ("some", 3e-12), ("big", 1e17), ("big", 1e19), ("thirds", 100 / 3), ("thirds", 100 / 3), ("thirds", 100 / 3)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["s"], r["a"]) for r in df.groupBy("k").agg(exact_sum("v").alias("s"), exact_avg("v").alias("a")).collect()}
    assert math.isnan(got["nan"][0]) and math.isnan(got["nan"][1]) and math.isnan(got["both"][0])
    assert got["inf"] == (inf, inf) and got["none"] == (None, None)
    assert got["some"] == (4e-12, 2e-12) and got["big"] == (1.01e19, 5.05e18)
    assert got["thirds"][0] == pytest.approx(100, abs=1e-13)


def test_bad_date_text_fails_with_ansi_on_or_off(spark):
    from marketlens.plans.promo import parse_date
    df = spark.createDataFrame([("2024-01-31",), (None,)], "d string")
    bad = spark.createDataFrame([("2024-01-31",), ("31.01.2024",)], "d string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            assert [str(r[0]) for r in df.select(parse_date("d")).collect()] == ["2024-01-31", "None"]
            with pytest.raises(Exception, match="not a yyyy-MM-dd date"):
                bad.select(parse_date("d")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_budget_and_capacity_tables(spark):
    from marketlens.plans import supply
    from marketlens.plans.registry import tables
    from tests.conftest import SMALL
    t = tables(spark, SMALL)
    base = supply.budget_variance(t).where("level = 0").first()
    nation = t["nation"].join(t["region"], t["nation"]["n_regionkey"] == t["region"]["r_regionkey"]).where("r_name = '%s'" % base["region"]).first()
    budget = spark.createDataFrame([(base["region"], nation["n_name"], base["year"], 12.34)], "region string, nation string, year int, budget_usd double")
    got = {(r["year"], r["region"]): r["budget_usd"] for r in supply.budget_variance(t, budget=budget).collect()}
    assert got[(base["year"], base["region"])] == 12.34 and got[(None, None)] == 12.34
    kind = supply.capacity_plan(t).first()["part_type"]
    cap = spark.createDataFrame([(kind, 1000.0)], "part_type string, units double")
    rows = supply.capacity_plan(t, cap).collect()
    assert all(r["utilisation"] == (r["units"] / 1000 if r["part_type"] == kind else None) for r in rows)


def test_supplier_lookup_deals_lines_before_it_groups_them(spark, monkeypatch):
    """Lines are dealt over tasks in step with their number; no pairs are summed or made distinct beside the scan."""
    import re

    from marketlens import session
    from marketlens.plans import pricing_ext, supply
    monkeypatch.setattr(session, "ROWS_A_TASK", 2)
    rows = [(1, 10, 2.0, 8.0), (1, 20, 2.0, 4.0), (1, 10, 2.0, 8.0), (2, 10, 1.0, 1.0), (3, 20, 1.0, 5.0), (None, 20, 1.0, 5.0), (2, None, 1.0, 3.0), (9, 20, 1.0, 5.0)]
    lines = spark.createDataFrame([(p, s, q, c, 0.0, "R" if s == 20 else "N") for p, s, q, c in rows],
                                  "l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,), (1,)], "p_partkey bigint")
    found = pricing_ext.supplier_performance_for(ids, {"lineitem": lines}, metrics=["volume", "price_level"])
    assert sorted(found.collect(), key=str) == sorted([(1, 10, 5.0, 1.666666667), (1, 20, 5.0, 0.5), (2, 10, 5.0, 1.666666667), (3, 20, 5.0, 0.5), (4, None, None, None)], key=str)
    for df, keys in ((found, "p_partkey"), (supply.price_levels({"lineitem": lines}), "l_partkey")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(rf"hashpartitioning\({keys}#\d+L?, (?:l_suppkey|supplier_key)#\d+L?, (\d+)\), (\w+)", plan)
        assert dealt and set(dealt) == {("4", "REPARTITION_BY_NUM")}


def test_lookups_keep_unknown_ids(spark):
    from marketlens.plans import pricing_ext
    from marketlens.plans.registry import tables
    from tests.conftest import SMALL
    t = tables(spark, SMALL)
    ids = spark.createDataFrame([(1,), (10**9,)], "p_partkey bigint")
    prices = {r["p_partkey"]: r for r in pricing_ext.competitor_prices_for(ids, t).collect()}
    assert prices[1]["observations"] > 0 and prices[10**9]["observations"] == 0
    chosen = pricing_ext.competitor_prices_for(ids, t, category="ECONOMY").collect()
    assert {r["product_category"] for r in chosen} == {"ECONOMY"}
    suppliers = pricing_ext.supplier_performance_for(ids, t, metrics=["score"]).collect()
    assert {r["p_partkey"] for r in suppliers} == {1, 10**9} and suppliers[0].asDict().keys() == {"p_partkey", "supplier_key", "score"}
    with pytest.raises(ValueError):
        pricing_ext.supplier_performance_for(ids, t, metrics=["nonsense"])
    assert {r["p_partkey"]: r["best_price"] is None for r in pricing_ext.optimal_price_for(ids, t).collect()} == {1: False, 10**9: True}


def test_insight_caps(spark, monkeypatch):
    """Ten insights, five recommendations and five alerts at most, the first in emission order."""
    from marketlens.plans import insights as I
    many = [I.Rule(kind, seq, f"r{seq}", lambda: F.lit(1.0), lambda: F.lit(True)) for kind in (I.INSIGHT, I.RECOMMENDATION, I.ALERT) for seq in range(1, 15)]
    monkeypatch.setitem(I.SUBJECT_RULES, "competitor_tracking", (lambda th: [F.count(F.lit(1)).alias("unused")], many))
    got = [(r["kind"], r["seq"]) for r in I.insights(spark.range(3), "competitor_tracking").collect()]
    assert sorted(got) == sorted([(I.INSIGHT, s) for s in range(1, 11)] + [(k, s) for k in (I.RECOMMENDATION, I.ALERT) for s in range(1, 6)])
