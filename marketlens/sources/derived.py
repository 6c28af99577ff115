"""The four fact tables of the reports, derived from the base tables.

The driver's data is TPC-H shaped; the report tables (competitor tracking,
campaign performance, price elasticity, promotional calendar) are recoded from
it by fixed rules (see FIXTURES.md section 2).  Each builder is a lazy join
plan, written so that Catalyst can push the report's date filter down to the
fact scan (lineitem or orders) before any join:

* fact tables are joined on their keys without hints; AQE turns a join into a
  broadcast only when the runtime size of a side is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise keeps the
  sort-merge join (skew-split by AQE);
* campaign metrics join line items with the orders of the window and then aggregate
  per order, which reuses the join's hash partitioning on the order key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str) -> Column:
    return F.col(name)


def geo_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Nation key -> nation and region names (25 rows in TPC-H shape)."""
    nation = tables["nation"].select("n_nationkey", "n_name", "n_regionkey")
    region = tables["region"].select("r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def competitor_tracking(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Competitor price observations: one per line item."""
    li = tables["lineitem"].select(
        "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    part = tables["part"].select("p_partkey", "p_type", "p_size", "p_retailprice")
    supp = tables["supplier"].select("s_suppkey", "s_name", "s_nationkey")
    geo = geo_of(tables)
    j = (li.join(part, li.l_partkey == part.p_partkey)
         .join(supp, li.l_suppkey == supp.s_suppkey)
         .join(geo, supp.s_nationkey == geo.n_nationkey))
    price = _c("p_retailprice")
    comp = F.round(price * (F.lit(0.7) + F.lit(0.02) * _c("l_quantity")), 2)
    rf, ls = _c("l_returnflag"), _c("l_linestatus")
    return j.select(
        _c("l_shipdate").cast("date").alias("tracking_date"),
        _c("s_name").alias("competitor"),
        _c("p_type").alias("product_category"),
        _c("r_name").alias("market"),
        price.alias("own_price_usd"),
        comp.alias("competitor_price_usd"),
        (F.lit(100) * (price - comp) / comp).alias("price_gap_pct"),
        F.when(_c("l_discount") >= 0.08, "TRUE").otherwise("FALSE").alias("promotion_flag"),
        F.when(_c("p_size") >= 34, "Superior").when(_c("p_size") >= 17, "Comparable")
        .otherwise("Inferior").alias("quality_comparison"),
        F.when(_c("p_partkey") % 3 == 0, "Premium").when(_c("p_partkey") % 3 == 1, "Mid-tier")
        .otherwise("Value").alias("brand_positioning"),
        F.when((rf == "A") & (ls == "F"), "Very Positive").when(rf == "A", "Positive")
        .when(rf == "N", "Neutral").otherwise("Negative").alias("market_share_impact"),
    )


def campaign_performance(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Campaign results: one per order, money kept in integer cents until the end."""
    li = tables["lineitem"].select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = tables["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = geo_of(tables)
    cents = lambda e: F.round(e * F.lit(100), 0).cast("bigint")
    # Join first: the report's date filter on the grouping column goes through the aggregate
    # into the orders scan, and orders outside the window drop their line items before they are
    # aggregated.  The aggregate needs no exchange of its own (the join dealt by order key).
    per_order = li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").agg(
        F.sum("l_quantity").alias("q"),
        F.sum(cents(_c("l_extendedprice"))).alias("gross_c"),
        F.sum(cents(_c("l_extendedprice") * (F.lit(1) - _c("l_discount")))).alias("net_c"),
        F.sum(cents(_c("l_discount"))).alias("disc_pts"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(_c("l_returnflag") == "R", 1)).alias("nr"),
    )
    j = (per_order.join(cust, per_order.o_custkey == cust.c_custkey)
         .join(geo, cust.c_nationkey == geo.n_nationkey))
    net = _c("net_c") / F.lit(1e2)
    cost = (_c("gross_c") * (F.lit(2) + _c("o_orderkey") % 8)).cast("bigint") * F.lit(5) / F.lit(1e4)
    return j.select(
        _c("o_orderdate").cast("date").alias("campaign_date"),
        F.concat(F.lit("Campaign-"), _c("o_orderkey").cast("string")).alias("campaign_name"),
        _c("o_orderpriority").alias("campaign_type"),
        _c("c_mktsegment").alias("target_audience"),
        (F.lit(4.0) * _c("disc_pts") / _c("n")).alias("discount_pct"),
        (_c("gross_c") / F.lit(1e2)).alias("original_price_usd"),
        net.alias("campaign_price_usd"),
        _c("q").cast("bigint").alias("units_sold"),
        net.alias("revenue_generated"),
        cost.alias("campaign_cost"),
        (F.lit(100) * (net / cost - F.lit(1))).alias("roi_pct"),
        _c("q").cast("bigint").alias("customer_acquisition"),
        (F.lit(1e2) * _c("nr") / _c("n")).alias("repeat_purchase_rate"),
        _c("r_name").alias("market_segment"),
    )


def price_elasticity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Price-point studies: one per line item, dated by its order."""
    li = tables["lineitem"].select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    part = tables["part"].select("p_partkey", "p_type", "p_retailprice")
    cust = tables["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = geo_of(tables)
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
         .join(part, li.l_partkey == part.p_partkey)
         .join(cust, orders.o_custkey == cust.c_custkey)
         .join(geo, cust.c_nationkey == geo.n_nationkey))
    q = _c("l_quantity")
    return j.select(
        _c("o_orderdate").cast("date").alias("analysis_date"),
        _c("p_type").alias("product_category"),
        _c("r_name").alias("market"),
        _c("p_retailprice").alias("price_point_usd"),
        q.cast("bigint").alias("demand_quantity"),
        (F.lit(0.1) + F.lit(0.06) * q).alias("elasticity_coefficient"),
        _c("c_mktsegment").alias("customer_segment"),
        F.when(q >= 32, "High").when(q >= 15, "Medium").otherwise("Low").alias("sensitivity_level"),
        (_c("p_retailprice") * (F.lit(0.8) + F.lit(0.06) * _c("l_linenumber"))).alias("optimal_price_usd"),
        ((_c("l_tax") - F.lit(0.04)) * F.lit(500)).alias("revenue_impact_pct"),
        ((_c("l_discount") - F.lit(0.05)) * F.lit(200)).alias("margin_impact_pct"),
        F.when(_c("l_returnflag") == "A", "Increase Price").when(_c("l_returnflag") == "R", "Decrease Price")
        .otherwise("Maintain Price").alias("recommendation"),
    )


def promotional_calendar(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Planned promotions: one per order; start and end dates are ISO text."""
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                     "o_orderdate", "o_orderpriority")
    cust = tables["customer"].select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = geo_of(tables)
    j = (orders.join(cust, orders.o_custkey == cust.c_custkey)
         .join(geo, cust.c_nationkey == geo.n_nationkey))
    day = _c("o_orderdate").cast("date")
    status, ck, ok = _c("o_orderstatus"), _c("o_custkey"), _c("o_orderkey")
    return j.select(
        F.concat(F.lit("PROMO-"), ok.cast("string")).alias("promo_id"),
        day.cast("string").alias("start_date"),
        F.date_add(day, (ok % 45).cast("int")).cast("string").alias("end_date"),
        F.concat(F.lit("Promo "), _c("c_mktsegment")).alias("campaign_name"),
        _c("r_name").alias("target_market"),
        _c("c_mktsegment").alias("product_category"),
        F.when(status == "F", "Percentage").when(status == "O", "Fixed Amount")
        .otherwise("Bundle").alias("discount_type"),
        F.when(status == "F", ck % 45).when(status == "O", ck % 350).otherwise(ck % 30)
        .cast("double").alias("discount_value"),
        (ck % 200).cast("double").alias("min_purchase_usd"),
        _c("o_orderpriority").alias("target_audience"),
        ((ok * 7) % 61).cast("double").alias("expected_uplift_pct"),
        (_c("o_totalprice") / F.lit(5)).alias("budget_usd"),
        F.when(ck % 4 == 0, "Email").when(ck % 4 == 1, "Social").when(ck % 4 == 2, "Store")
        .otherwise("App").alias("channel"),
        (F.lit(0.8) + F.lit(0.1) * (F.month(_c("o_orderdate")) % 5)).alias("seasonality_factor"),
        F.when(ok % 3 == 0, "High").when(ok % 3 == 1, "Medium").otherwise("Low").alias("competitive_response"),
    )


FACT_BUILDERS = {
    "competitor_tracking": competitor_tracking,
    "campaign_performance": campaign_performance,
    "price_elasticity": price_elasticity,
    "promotional_calendar": promotional_calendar,
}
