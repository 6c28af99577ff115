"""Physical-plan checks: filters reach the scan, the rollup join does not shuffle the detail."""

from marketlens.config import STUDY_WINDOW
from marketlens.plans import competitor
from marketlens.plans.registry import tables
from marketlens.sources import derived
from tests.conftest import SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_window_pushed_into_lineitem_scan(spark):
    d = competitor.detail(derived.competitor_tracking(tables(spark, SMALL)))
    plan = d._jdf.queryExecution().optimizedPlan().toString() + _plan(d)
    assert "l_shipdate" in plan
    explained = d._sc._jvm.PythonSQLUtils.explainString(d._jdf.queryExecution(), "formatted") \
        if hasattr(d._sc._jvm, "PythonSQLUtils") else ""
    text = explained or plan
    assert "PushedFilters" in text and "GreaterThanOrEqual(l_shipdate" in text


def test_column_pruning_on_lineitem(spark):
    d = competitor.detail(derived.competitor_tracking(tables(spark, SMALL)))
    text = _plan(d)
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_window_mode_report_has_no_cartesian_product(spark):
    plan = competitor.build(derived.competitor_tracking(tables(spark, SMALL)), STUDY_WINDOW, rank_mode="window")
    text = _plan(plan.report(100))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "TakeOrderedAndProject" in text


def _final(df) -> str:
    """The plan that ran, after adaptive re-planning."""
    df.write.format("noop").mode("overwrite").save()
    return _plan(df)


def test_campaign_window_reaches_orders_below_the_aggregate(spark):
    from marketlens.plans import campaign
    d = campaign.detail(derived.campaign_performance(tables(spark, SMALL)), STUDY_WINDOW)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    aggregate, join = plan.index("Aggregate"), plan.index("l_orderkey", plan.index("Aggregate"))
    assert aggregate < join and "o_orderdate" in plan[aggregate:] and "Filter" in plan[aggregate:]
    assert "PushedFilters: [IsNotNull(o_orderdate)" in _plan(d) or "GreaterThanOrEqual(o_orderdate" in _plan(d)


def test_unranked_outputs_write_and_rank_nothing(spark):
    from marketlens.plans.registry import QUERIES
    from marketlens.session import recording
    for prefix in ("competitor", "campaign", "elasticity", "promo"):
        for kind in ("segments", "summary", "insights", "report_summary", "report_insights"):
            with recording() as folders:
                QUERIES[f"{prefix}_{kind}"](spark, SMALL)
            assert not folders, (prefix, kind)


def test_reports_write_nothing_and_keep_few_rows(spark):
    from marketlens.plans.registry import QUERIES, subject_plan
    from marketlens.session import recording
    for prefix in ("competitor", "campaign", "elasticity", "promo"):
        with recording() as folders:
            assert QUERIES[f"{prefix}_report"](spark, SMALL).count() == 100
        assert not folders
        text = _plan(subject_plan(prefix, spark, SMALL)._choose(7))
        assert "TakeOrderedAndProject" in text and "SinglePartition" not in text


def _scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_summaries_and_insights_read_the_detail_once(spark):
    from marketlens.plans.registry import QUERIES, SUBJECTS, facts_of
    for prefix in ("competitor", "campaign", "elasticity", "promo"):
        module = SUBJECTS[prefix][0]
        once = _scans(module.detail(facts_of(prefix, spark, SMALL), STUDY_WINDOW))
        assert _scans(QUERIES[f"{prefix}_summary"](spark, SMALL)) <= once
        if prefix != "campaign":  # its rules need a label that reads the rollup
            assert _scans(QUERIES[f"{prefix}_insights"](spark, SMALL)) <= once
        assert _scans(QUERIES[f"{prefix}_segments"](spark, SMALL)) <= once


def test_no_registered_plan_puts_rows_on_one_task(spark):
    """Single-partition exchanges may only carry one row a bucket, a source or an aggregate."""
    from marketlens.plans.registry import QUERIES
    for name in ("competitor_report", "campaign_report", "elasticity_ranks", "promo_labels", "tb_supplier_scorecard", "tb_price_rule_table"):
        lines = _plan(QUERIES[name](spark, SMALL)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate(keys=[_bucket" in lines[i + 1] or "partial_" in lines[i + 1], (name, lines[i + 1])


def test_tier_b_reads_its_fact_once(spark):
    from marketlens.plans.registry import QUERIES
    from marketlens.session import recording
    for name in ("tb_market_entries", "tb_market_forecast"):
        with recording() as folders:
            df = QUERIES[name](spark, SMALL)
        assert len(folders) == 1 and "lineitem" not in _plan(df)
    assert _plan(QUERIES["tb_brand_rollup"](spark, SMALL)).count("lineitem.parquet") == 1
