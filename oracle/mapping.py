"""DuckDB text of the fixture mapping (FIXTURES.md section 2): base tables -> report tables."""

MAPPING = {
    "competitor_tracking": """
SELECT CAST(l.l_shipdate AS DATE) AS tracking_date, s.s_name AS competitor, p.p_type AS product_category, r.r_name AS market,
 p.p_retailprice AS own_price_usd, ROUND(p.p_retailprice*(0.7+0.02*l.l_quantity),2) AS competitor_price_usd,
 100*(p.p_retailprice-ROUND(p.p_retailprice*(0.7+0.02*l.l_quantity),2))/ROUND(p.p_retailprice*(0.7+0.02*l.l_quantity),2) AS price_gap_pct,
 CASE WHEN l.l_discount >= 0.08 THEN 'TRUE' ELSE 'FALSE' END AS promotion_flag,
 CASE WHEN p.p_size>=34 THEN 'Superior' WHEN p.p_size>=17 THEN 'Comparable' ELSE 'Inferior' END AS quality_comparison,
 CASE WHEN p.p_partkey%3=0 THEN 'Premium' WHEN p.p_partkey%3=1 THEN 'Mid-tier' ELSE 'Value' END AS brand_positioning,
 CASE WHEN l.l_returnflag='A' AND l.l_linestatus='F' THEN 'Very Positive' WHEN l.l_returnflag='A' THEN 'Positive' WHEN l.l_returnflag='N' THEN 'Neutral' ELSE 'Negative' END AS market_share_impact
FROM lineitem l
JOIN part p ON l.l_partkey=p.p_partkey
JOIN supplier s ON l.l_suppkey=s.s_suppkey
JOIN nation n ON s.s_nationkey=n.n_nationkey
JOIN region r ON n.n_regionkey=r.r_regionkey
""",
    "campaign_performance": """
WITH x AS (SELECT l_orderkey, SUM(l_quantity) q, SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) gross_c, SUM(CAST(ROUND(l_extendedprice*(1-l_discount)*100) AS BIGINT)) net_c,
 SUM(CAST(ROUND(l_discount*100) AS BIGINT)) disc_pts, COUNT(*) n, COUNT(CASE WHEN l_returnflag='R' THEN 1 END) nr
FROM lineitem GROUP BY l_orderkey)
SELECT CAST(o.o_orderdate AS DATE) AS campaign_date, CONCAT('Campaign-',CAST(o.o_orderkey AS STRING)) AS campaign_name, o.o_orderpriority AS campaign_type, c.c_mktsegment AS target_audience,
 4.0e0*x.disc_pts/x.n AS discount_pct, x.gross_c/1e2 AS original_price_usd, x.net_c/1e2 AS campaign_price_usd, CAST(x.q AS BIGINT) AS units_sold, x.net_c/1e2 AS revenue_generated,
 CAST(x.gross_c*(2+o.o_orderkey%8) AS BIGINT)*5/1e4 AS campaign_cost, 100*((x.net_c/1e2)/(CAST(x.gross_c*(2+o.o_orderkey%8) AS BIGINT)*5/1e4)-1) AS roi_pct,
 CAST(x.q AS BIGINT) AS customer_acquisition, 1e2*x.nr/x.n AS repeat_purchase_rate, r.r_name AS market_segment
FROM orders o
JOIN x ON o.o_orderkey=x.l_orderkey
JOIN customer c ON o.o_custkey=c.c_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey
JOIN region r ON n.n_regionkey=r.r_regionkey
""",
    "price_elasticity": """
SELECT CAST(o.o_orderdate AS DATE) AS analysis_date, p.p_type AS product_category, r.r_name AS market, p.p_retailprice AS price_point_usd, CAST(l.l_quantity AS BIGINT) AS demand_quantity,
 0.1e0+0.06e0*l.l_quantity AS elasticity_coefficient, c.c_mktsegment AS customer_segment,
 CASE WHEN l.l_quantity>=32 THEN 'High' WHEN l.l_quantity>=15 THEN 'Medium' ELSE 'Low' END AS sensitivity_level,
 p.p_retailprice*(0.8e0+0.06e0*l.l_linenumber) AS optimal_price_usd, (l.l_tax-0.04e0)*500 AS revenue_impact_pct, (l.l_discount-0.05e0)*200 AS margin_impact_pct,
 CASE l.l_returnflag WHEN 'A' THEN 'Increase Price' WHEN 'R' THEN 'Decrease Price' ELSE 'Maintain Price' END AS recommendation
FROM lineitem l
JOIN part p ON l.l_partkey=p.p_partkey
JOIN orders o ON l.l_orderkey=o.o_orderkey
JOIN customer c ON o.o_custkey=c.c_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey
JOIN region r ON n.n_regionkey=r.r_regionkey
""",
    "promotional_calendar": """
SELECT CONCAT('PROMO-',CAST(o.o_orderkey AS STRING)) AS promo_id, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS start_date, CAST(CAST(o.o_orderdate AS DATE)+CAST(o.o_orderkey%45 AS INT) AS STRING) AS end_date,
 CONCAT('Promo ',c.c_mktsegment) AS campaign_name, r.r_name AS target_market, c.c_mktsegment AS product_category,
 CASE o.o_orderstatus WHEN 'F' THEN 'Percentage' WHEN 'O' THEN 'Fixed Amount' ELSE 'Bundle' END AS discount_type,
 CAST(CASE o.o_orderstatus WHEN 'F' THEN o.o_custkey%45 WHEN 'O' THEN o.o_custkey%350 ELSE o.o_custkey%30 END AS DOUBLE) AS discount_value,
 CAST(o.o_custkey%200 AS DOUBLE) AS min_purchase_usd, o.o_orderpriority AS target_audience, CAST((o.o_orderkey*7)%61 AS DOUBLE) AS expected_uplift_pct, o.o_totalprice/5 AS budget_usd,
 CASE o.o_custkey%4 WHEN 0 THEN 'Email' WHEN 1 THEN 'Social' WHEN 2 THEN 'Store' ELSE 'App' END AS channel, 0.8e0+0.1e0*(EXTRACT(MONTH
FROM o.o_orderdate)%5) AS seasonality_factor,
 CASE o.o_orderkey%3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS competitive_response
FROM orders o
JOIN customer c ON o.o_custkey=c.c_custkey
JOIN nation n ON c.c_nationkey=n.n_nationkey
JOIN region r ON n.n_regionkey=r.r_regionkey
""",
}
