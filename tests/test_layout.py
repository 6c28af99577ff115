"""Month-partitioned report tables: same reports, and the window prunes partitions."""

import tempfile

import pytest

from marketlens.config import STUDY_WINDOW
from marketlens.plans import campaign, competitor, elasticity, promo
from marketlens.plans.registry import tables
from marketlens.sources import derived
from marketlens.sources.layout import read_facts, write_facts
from tests.conftest import SMALL

CASES = [(competitor, derived.competitor_tracking), (campaign, derived.campaign_performance),
         (elasticity, derived.price_elasticity), (promo, derived.promotional_calendar)]


@pytest.fixture(scope="module")
def laid_out(spark):
    root = tempfile.mkdtemp(prefix="ml-layout-")
    write_facts(tables(spark, SMALL), root)
    return root


@pytest.mark.parametrize("module,builder", CASES)
def test_partitioned_facts_give_the_same_report(spark, laid_out, module, builder):
    base = module.build(builder(tables(spark, SMALL)), STUDY_WINDOW, rank_mode="window").report(100).collect()
    facts = read_facts(spark, laid_out, module.SUBJECT)
    plan = module.build(facts, STUDY_WINDOW, rank_mode="window")
    assert plan.report(100).collect() == base
    scan = module.detail(facts, STUDY_WINDOW)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in scan and "_month" in scan


def test_bucketed_order_tables_join_without_exchange(spark):
    from marketlens.sources.layout import Layered, write_bucketed
    spark.sql("CREATE DATABASE IF NOT EXISTS ml_bucketed")
    base = tables(spark, SMALL)
    write_bucketed(base, "ml_bucketed", buckets=4)
    layered = Layered(spark, "ml_bucketed", ["lineitem", "orders"], base)
    facts = derived.campaign_performance(layered)
    # as at scale: no broadcast, so the join must be a sort-merge join on co-located buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [l_orderkey" in plan
    # the per-order aggregation and the orders join read co-located buckets: no hash exchange on the order key
    assert "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(o_orderkey" not in plan
    want = campaign.build(derived.campaign_performance(base), STUDY_WINDOW, rank_mode="window").report(50).collect()
    got = campaign.build(facts, STUDY_WINDOW, rank_mode="window").report(50).collect()
    assert got == want
