"""DuckDB oracle SQL for the Tier B queries (our own definitions, see plans/)."""

from __future__ import annotations

from oracle.fixed_values import COST_SHARE, FREIGHT, GRID, LATE_DAYS, MARKET_RULES, PRICE_RULES, SCORE_WEIGHTS
from oracle.mapping import MAPPING

GEO = """geo AS (SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""
CT = f"competitor_tracking AS ({MAPPING['competitor_tracking']})"
XAVG = "CAST(SUM(CAST({c} AS DECIMAL(38,10))) AS DOUBLE) / NULLIF(COUNT({c}), 0)"


def xavg(c: str) -> str:
    return XAVG.format(c=c)


def quality_trend() -> str:
    return """
WITH m AS (
  SELECT l_suppkey AS supplier_key, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         COUNT(*) AS lines, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
  FROM lineitem GROUP BY 1, 2)
SELECT supplier_key, month, lines, returned, returned / lines AS return_rate,
       LAG(returned / lines) OVER (PARTITION BY supplier_key ORDER BY month) AS prev_return_rate,
       returned / lines - LAG(returned / lines) OVER (PARTITION BY supplier_key ORDER BY month) AS rate_change
FROM m"""


def delivery_performance() -> str:
    return f"""
WITH {GEO},
h AS (
  SELECT g.n_name AS supplier_nation, CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS BIGINT) AS days,
         COUNT(*) AS n
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN geo g ON s.s_nationkey = g.n_nationkey GROUP BY 1, 2),
c AS (
  SELECT *, SUM(n) OVER (PARTITION BY supplier_nation ORDER BY days ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         SUM(n) OVER (PARTITION BY supplier_nation) AS total FROM h)
SELECT supplier_nation, CAST(SUM(n) AS BIGINT) AS shipments, SUM(days * n) / SUM(n) AS mean_days,
       MIN(CASE WHEN cum >= CEIL(total * 0.5) THEN days END) AS p50_days,
       MIN(CASE WHEN cum >= CEIL(total * 0.9) THEN days END) AS p90_days,
       SUM(CASE WHEN days > {LATE_DAYS} THEN n ELSE 0 END) / SUM(n) AS late_share
FROM c GROUP BY supplier_nation"""


def budget_variance(uplift_pct: int = 5) -> str:
    return f"""
WITH {GEO},
a AS (
  SELECT g.r_name AS region, g.n_name AS nation, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         SUM(CAST(ROUND(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)) AS actual_c
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN geo g ON c.c_nationkey = g.n_nationkey GROUP BY 1, 2, 3),
b AS (SELECT region, nation, year + 1 AS year, actual_c * {100 + uplift_pct} AS budget_c100 FROM a),
j AS (SELECT COALESCE(a.region, b.region) AS region, COALESCE(a.nation, b.nation) AS nation,
             COALESCE(a.year, b.year) AS year, a.actual_c, b.budget_c100
      FROM a FULL OUTER JOIN b ON a.region = b.region AND a.nation = b.nation AND a.year = b.year),
r AS (SELECT year, region, CAST(GROUPING_ID(year, region) AS BIGINT) AS level,
             SUM(actual_c) / 100.0 AS actual_usd, SUM(budget_c100) / 10000.0 AS budget_usd
      FROM j GROUP BY ROLLUP (year, region))
SELECT year, region, level, CAST(actual_usd AS DOUBLE) AS actual_usd, CAST(budget_usd AS DOUBLE) AS budget_usd,
       CAST(actual_usd AS DOUBLE) - CAST(budget_usd AS DOUBLE) AS variance_usd,
       100.0 * (CAST(actual_usd AS DOUBLE) - CAST(budget_usd AS DOUBLE)) / NULLIF(CAST(budget_usd AS DOUBLE), 0.0) AS variance_pct
FROM r"""


def _scorecard_cte() -> str:
    wv, wr, wp = SCORE_WEIGHTS["volume"], SCORE_WEIGHTS["return_rate"], SCORE_WEIGHTS["price_level"]
    return f"""
own AS (
  SELECT l_partkey, l_suppkey, SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS c, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
pairs_of AS (
  SELECT a.l_suppkey, a.q, CAST(a.c AS DOUBLE) / a.q AS price, SUM(b.c) AS oc, SUM(b.q) AS oq
  FROM own a JOIN own b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY a.l_partkey, a.l_suppkey, a.q, a.c),
lv AS (
  SELECT l_suppkey, CAST(SUM(CAST(ROUND(q * (price / (CAST(oc AS DOUBLE) / oq)), 9) AS DECIMAL(38,9))) AS DOUBLE) / SUM(q) AS price_level
  FROM pairs_of GROUP BY 1),
st AS (
  SELECT l.l_suppkey AS supplier_key, SUM(l_quantity) AS volume,
         COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) / COUNT(*) AS return_rate,
         {xavg('l_discount')} AS avg_discount, ROUND(COALESCE(ANY_VALUE(lv.price_level), 1.0), 9) AS price_level
  FROM lineitem l LEFT JOIN lv ON l.l_suppkey = lv.l_suppkey GROUP BY l.l_suppkey),
card AS (
  SELECT *, ROUND(CAST({wv} AS DOUBLE) * pr_volume + CAST({wr} AS DOUBLE) * (1 - pr_return_rate)
                  + CAST({wp} AS DOUBLE) * (1 - pr_price_level), 6) AS score
  FROM (SELECT *, PERCENT_RANK() OVER (ORDER BY volume ASC NULLS FIRST) AS pr_volume,
               PERCENT_RANK() OVER (ORDER BY return_rate ASC NULLS FIRST) AS pr_return_rate,
               PERCENT_RANK() OVER (ORDER BY price_level ASC NULLS FIRST) AS pr_price_level
        FROM st) t)"""


def supplier_scorecard() -> str:
    return "WITH" + _scorecard_cte() + "\nSELECT * FROM card"


def capacity_plan() -> str:
    return """
WITH m AS (
  SELECT p.p_type AS part_type, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month, SUM(l.l_quantity) AS units
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2)
SELECT part_type, month, units,
       SUM(units) OVER (PARTITION BY part_type ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
         / COUNT(units) OVER (PARTITION BY part_type ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_avg_3m,
       units / MAX(units) OVER (PARTITION BY part_type) AS utilisation
FROM m"""


def shipping_cost() -> str:
    share, unit = FREIGHT
    return f"""
WITH {GEO},
f AS (
  SELECT g.n_name AS supplier_nation, l.l_extendedprice * CAST({share} AS DOUBLE) + l.l_quantity * CAST({unit} AS DOUBLE) AS cost
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN geo g ON s.s_nationkey = g.n_nationkey),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY supplier_nation ORDER BY cost) AS i, COUNT(*) OVER (PARTITION BY supplier_nation) AS m FROM f)
SELECT supplier_nation, COUNT(*) AS shipments, ROUND(fsum(cost), 4) AS total_cost, ROUND(favg(cost), 6) AS mean_cost,
       MIN(CASE WHEN i >= CEIL(m * 0.5) THEN cost END) AS p50_cost, MIN(CASE WHEN i >= CEIL(m * 0.9) THEN cost END) AS p90_cost
FROM n GROUP BY supplier_nation"""


def production_plan(capacity: str = "") -> str:
    """Backlog by recursion, month after month."""
    limits = capacity or """SELECT part_type, CAST(FLOOR(SUM(units) / (date_diff('month', MIN(month), MAX(month)) + 1)) AS DOUBLE) AS capacity FROM m GROUP BY 1"""
    return f"""
WITH RECURSIVE m AS (
  SELECT p.p_type AS part_type, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS month, SUM(l.l_quantity) AS units
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
lim AS ({limits}),
span AS (SELECT part_type, MIN(month) AS lo, MAX(month) AS hi FROM m GROUP BY 1),
grid AS (SELECT part_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month, lo FROM span),
d AS (SELECT g.part_type, g.month, date_diff('month', g.lo, g.month) AS t, COALESCE(m.units, 0.0) AS units, lim.capacity
      FROM grid g LEFT JOIN m ON g.part_type = m.part_type AND g.month = m.month LEFT JOIN lim ON g.part_type = lim.part_type),
run AS (
  SELECT part_type, month, t, units, capacity, CAST(0 AS DOUBLE) AS before, GREATEST(CAST(0 AS DOUBLE), units - capacity) AS backlog FROM d WHERE t = 0
  UNION ALL
  SELECT d.part_type, d.month, d.t, d.units, d.capacity, run.backlog, GREATEST(CAST(0 AS DOUBLE), run.backlog + d.units - d.capacity)
  FROM run JOIN d ON d.part_type = run.part_type AND d.t = run.t + 1)
SELECT part_type, month, units, capacity, IF(capacity IS NULL, NULL, units + before - backlog) AS produced, IF(capacity IS NULL, NULL, backlog) AS backlog,
       IF(capacity IS NULL, NULL, (units + before - backlog) / NULLIF(capacity, 0.0)) AS utilisation
FROM run"""


def production_plan_given() -> str:
    return production_plan("SELECT p_type AS part_type, CAST(COUNT(*) * 40 AS DOUBLE) AS capacity FROM part WHERE p_size % 2 = 0 GROUP BY 1")


def _rule_join(rules: str, parts: str, more: str = "") -> str:
    """All rules that match a part, the best one by row number."""
    return f"""
WITH {GEO}, {CT},
rules AS ({rules}),
parts AS ({parts}),
hit AS (
  SELECT p.*, r.rule_id, r.adjustment_pct, ROW_NUMBER() OVER (PARTITION BY p.p_partkey ORDER BY r.priority, r.rule_id) AS rn
  FROM parts p LEFT JOIN rules r ON p.p_retailprice >= r.min_price AND (p.p_retailprice < r.max_price OR r.max_price IS NULL)
    AND p.p_size BETWEEN r.min_size AND r.max_size {more})
SELECT p_partkey, p_type, p_size, p_retailprice, COALESCE(rule_id, 'none') AS rule_id,
       ROUND(p_retailprice * (CAST(1.0 AS DOUBLE) + COALESCE(adjustment_pct, CAST(0.0 AS DOUBLE)) / CAST(100.0 AS DOUBLE)), 2) AS new_price
FROM hit WHERE rn = 1"""


def price_rule_table_large() -> str:
    return _rule_join("""SELECT p_partkey % 997 AS priority, 'band_' || p_partkey AS rule_id, ROUND(p_retailprice - p_partkey % 40, 2) AS min_price,
       CASE WHEN p_partkey % 7 = 0 THEN CAST(1e12 AS DOUBLE) ELSE ROUND(p_retailprice + p_partkey % 25, 2) END AS max_price,
       p_size - p_partkey % 3 AS min_size, p_size + p_partkey % 5 AS max_size, CAST(p_partkey % 31 - 15 AS DOUBLE) AS adjustment_pct FROM part""",
                      "SELECT p_partkey, p_type, p_size, p_retailprice FROM part")


def market_rules() -> str:
    value = lambda v: "NULL" if v is None else f"CAST({v} AS DOUBLE)"
    rules = " UNION ALL ".join(
        f"SELECT {priority} + h % 10 AS priority, '{name}_' || p_type AS rule_id, CAST(h % 500 + 900 AS DOUBLE) AS min_price, CAST(NULL AS DOUBLE) AS max_price, 1 AS min_size, "
        f"50 AS max_size, {value(change)} AS adjustment_pct, {value(a)} AS min_gap, {value(b)} AS max_gap, {value(c)} AS min_demand, {value(d)} AS max_demand FROM kinds"
        for name, priority, change, a, b, c, d in MARKET_RULES)
    parts = f"""SELECT p.p_partkey, p.p_type, p.p_size, p.p_retailprice, g.gap, COALESCE(s.demand, 0.0) AS demand
  FROM part p LEFT JOIN (SELECT product_category, ROUND({xavg('price_gap_pct')}, 2) AS gap FROM competitor_tracking GROUP BY 1) g ON p.p_type = g.product_category
  LEFT JOIN (SELECT l_partkey, SUM(l_quantity) AS demand FROM lineitem GROUP BY 1) s ON p.p_partkey = s.l_partkey"""
    more = " ".join(f"AND (r.min_{c} IS NULL OR p.{c} >= r.min_{c}) AND (r.max_{c} IS NULL OR p.{c} < r.max_{c})" for c in ("gap", "demand"))
    sql = _rule_join(rules, parts, more)
    return sql.replace("\nrules AS", "\nkinds AS (SELECT DISTINCT p_type, length(p_type) * 37 + ascii(p_type) AS h FROM part),\nrules AS", 1)


def price_monitor() -> str:
    return f"""
WITH {CT},
m AS (
  SELECT competitor, market, CAST(date_trunc('month', tracking_date) AS DATE) AS month, COUNT(*) AS observations,
         ROUND({xavg('competitor_price_usd')}, 9) AS avg_price
  FROM competitor_tracking GROUP BY 1, 2, 3)
SELECT *, 100.0 * (avg_price - prev_avg_price) / NULLIF(prev_avg_price, 0.0) AS change_pct
FROM (SELECT *, LAG(avg_price) OVER (PARTITION BY competitor, market ORDER BY month) AS prev_avg_price FROM m) t"""


def market_entries() -> str:
    return f"""
WITH {CT},
seen AS (SELECT DISTINCT market, CAST(date_trunc('month', tracking_date) AS DATE) AS month, competitor FROM competitor_tracking),
ends AS (SELECT MIN(month) AS lo, MAX(month) AS hi FROM seen),
grid AS (SELECT market, competitor, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month, lo
         FROM (SELECT DISTINCT market, competitor FROM seen) c, ends),
state AS (SELECT g.*, s.month IS NOT NULL AS here, LAG(s.month IS NOT NULL) OVER (PARTITION BY g.market, g.competitor ORDER BY g.month) AS before
          FROM grid g LEFT JOIN seen s ON g.market = s.market AND g.competitor = s.competitor AND g.month = s.month)
SELECT market, month, COUNT(*) FILTER (here) AS competitors, COUNT(*) FILTER (here AND NOT before) AS entrants,
       COUNT(*) FILTER (NOT here AND before) AS leavers
FROM state GROUP BY 1, 2 HAVING COUNT(*) FILTER (here OR before) > 0"""


def market_forecast(horizon: int = 3) -> str:
    return f"""
WITH {CT},
m AS (SELECT market, CAST(date_trunc('month', tracking_date) AS DATE) AS month, {xavg('competitor_price_usd')} AS y
      FROM competitor_tracking GROUP BY 1, 2),
p AS (SELECT *, CAST((year(month) - 1970) * 12 + month(month) - 1 AS BIGINT) AS t FROM m),
f0 AS (SELECT market, COUNT(*) AS n, SUM(t) AS st, SUM(t * t) AS stt,
              CAST(SUM(CAST(y AS DECIMAL(38,6))) AS DOUBLE) AS sy, CAST(SUM(CAST(y * t AS DECIMAL(38,6))) AS DOUBLE) AS sty,
              MAX(t) AS t_last FROM p GROUP BY market),
f1 AS (SELECT *, CASE WHEN (n * stt - st * st) <> 0 THEN (n * sty - st * sy) / (n * stt - st * st) ELSE 0.0 END AS slope FROM f0),
f AS (SELECT *, (sy - slope * st) / n AS intercept FROM f1),
s0 AS (SELECT market, month(month) AS cal_month, {xavg('y')} AS m_mean FROM p GROUP BY 1, 2),
o AS (SELECT market, {xavg('y')} AS all_mean FROM p GROUP BY 1),
s AS (SELECT s0.market, CAST(s0.cal_month AS INTEGER) AS cal_month, m_mean / all_mean AS seasonal_index FROM s0 JOIN o USING (market)),
a AS (SELECT market, CAST(h AS INTEGER) AS h, slope, intercept, t_last + h AS tn FROM f, range(1, {horizon + 1}) r(h)),
b AS (SELECT market, h, slope, make_date(CAST(floor(tn / 12) AS BIGINT) + 1970, CAST(tn % 12 AS BIGINT) + 1, 1) AS month,
             intercept + slope * tn AS trend, CAST(tn % 12 + 1 AS INTEGER) AS cal_month FROM a)
SELECT b.market, b.h AS horizon, b.month, ROUND(slope, 4) AS slope, ROUND(trend, 4) AS trend,
       ROUND(COALESCE(seasonal_index, 1.0), 4) AS seasonal_index, ROUND(trend * COALESCE(seasonal_index, 1.0), 4) AS forecast
FROM b LEFT JOIN s ON b.market = s.market AND b.cal_month = s.cal_month"""


def seasonal_forecast(horizon: int = 3, holdout: int = 3) -> str:
    """The moving mean as a self-join of the months, weights one half at the ends."""
    exact = lambda c: f"CAST(SUM(CAST({c} AS DECIMAL(38,9))) AS DOUBLE)"
    return f"""
WITH {CT},
m AS (SELECT market, CAST((year(tracking_date) - 1970) * 12 + month(tracking_date) - 1 AS INTEGER) AS t, {xavg('competitor_price_usd')} AS y
      FROM competitor_tracking WHERE market IS NOT NULL GROUP BY 1, 2 HAVING COUNT(competitor_price_usd) > 0),
fits AS (SELECT market, 'holdout' AS kind, MAX(t) - {holdout} AS until, {holdout} AS ahead FROM m GROUP BY 1
         UNION ALL SELECT market, 'ahead', MAX(t), {horizon} FROM m GROUP BY 1),
seen AS (SELECT f.market, f.kind, m.t, m.y FROM m JOIN fits f ON m.market = f.market AND m.t <= f.until),
r AS (SELECT a.market, a.kind, a.t, a.y / ({exact('CASE WHEN abs(a.t - b.t) = 6 THEN b.y ELSE 2 * b.y END')} / 24) AS ratio
      FROM seen a JOIN seen b ON a.market = b.market AND a.kind = b.kind AND abs(a.t - b.t) <= 6
      GROUP BY a.market, a.kind, a.t, a.y HAVING COUNT(*) = 13),
s0 AS (SELECT market, kind, t % 12 AS cal, {exact('ratio')} / COUNT(*) AS season FROM r GROUP BY 1, 2, 3),
s1 AS (SELECT market, kind, {exact('season')} / COUNT(*) AS mean FROM s0 GROUP BY 1, 2),
s AS (SELECT s0.market, s0.kind, cal, season / mean AS season FROM s0 JOIN s1 ON s0.market = s1.market AND s0.kind = s1.kind),
a AS (SELECT seen.market, seen.kind, t, y / COALESCE(season, 1.0) AS a FROM seen
      LEFT JOIN s ON seen.market = s.market AND seen.kind = s.kind AND seen.t % 12 = s.cal),
f0 AS (SELECT market, kind, COUNT(*) AS n, SUM(t) AS sx, SUM(t * t) AS sxx, {exact('a')} AS sy, {exact('t * a')} AS sxy FROM a GROUP BY 1, 2),
f1 AS (SELECT *, CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END AS slope FROM f0),
f AS (SELECT market, kind, slope, (sy - slope * sx) / n AS level FROM f1),
steps AS (SELECT market, kind, CAST(until + unnest(range(1, ahead + 1)) AS INTEGER) AS t FROM fits),
o AS (SELECT steps.market, steps.kind, steps.t, COALESCE(season, 1.0) AS idx, level + slope * steps.t AS line, m.y AS actual
      FROM steps JOIN f ON steps.market = f.market AND steps.kind = f.kind
      LEFT JOIN s ON steps.market = s.market AND steps.kind = s.kind AND steps.t % 12 = s.cal
      LEFT JOIN m ON steps.market = m.market AND steps.t = m.t
      WHERE steps.kind = 'ahead' OR m.y IS NOT NULL),
e AS (SELECT *, CASE WHEN kind = 'holdout' THEN 100.0 * abs(line * idx - actual) / NULLIF(abs(actual), 0.0) END AS err FROM o),
g AS (SELECT market AS g, {exact('err')} / NULLIF(COUNT(err), 0) AS mape FROM e GROUP BY 1)
SELECT market, kind, make_date(CAST(floor(t / 12) AS BIGINT) + 1970, CAST(t % 12 AS BIGINT) + 1, 1) AS month,
       ROUND(idx, 4) AS seasonal_index, ROUND(line, 4) AS trend, ROUND(line * idx, 4) AS forecast,
       CASE WHEN kind = 'holdout' THEN ROUND(actual, 4) END AS actual, ROUND(err, 4) AS error_pct, ROUND(mape, 4) AS holdout_mape
FROM e JOIN g ON e.market = g.g"""


def price_rules() -> str:
    arms_id, arms_adj = [], []
    for _, rule, low, high, small, large, change in sorted(PRICE_RULES):
        cond = f"p_retailprice >= CAST({low!r} AS DOUBLE) AND p_retailprice < CAST({high!r} AS DOUBLE) AND p_size BETWEEN {small} AND {large}"
        arms_id.append(f"WHEN {cond} THEN '{rule}'")
        arms_adj.append(f"WHEN {cond} THEN CAST({change!r} AS DOUBLE)")
    return f"""
SELECT p_partkey, p_type, p_size, p_retailprice, CASE {' '.join(arms_id)} ELSE 'none' END AS rule_id,
       ROUND(p_retailprice * (CAST(1.0 AS DOUBLE) + (CASE {' '.join(arms_adj)} ELSE CAST(0.0 AS DOUBLE) END) / CAST(100.0 AS DOUBLE)), 2) AS new_price
FROM part"""


def elasticity_curves() -> str:
    return f"""
WITH {GEO},
pts AS (
  SELECT g.r_name AS market, p.p_type AS product_category,
         CAST(ROUND(LN(l.l_extendedprice * (1 - l.l_discount) / l.l_quantity), 9) AS DECIMAL(18,9)) AS x,
         CAST(ROUND(LN(l.l_quantity), 9) AS DECIMAL(18,9)) AS y
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.n_nationkey
  WHERE l.l_quantity > 0 AND l.l_extendedprice > 0 AND l.l_discount < 1),
s AS (SELECT market, product_category, COUNT(*) AS points,
             CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(y) AS DOUBLE) AS sy, CAST(SUM(x * x) AS DOUBLE) AS sxx,
             CAST(SUM(y * y) AS DOUBLE) AS syy, CAST(SUM(x * y) AS DOUBLE) AS sxy
      FROM pts GROUP BY 1, 2),
v AS (SELECT *, points * sxx - sx * sx AS vx, points * syy - sy * sy AS vy, points * sxy - sx * sy AS cxy FROM s)
SELECT market, product_category, points,
       ROUND(CASE WHEN vx > 0 THEN cxy / vx END, 6) AS elasticity_slope,
       ROUND(CASE WHEN vx > 0 AND vy > 0 THEN cxy * cxy / (vx * vy) END, 6) AS r_squared
FROM v"""


def _optimal_cte() -> str:
    start, step, n = GRID
    return f"""
price_elasticity AS ({MAPPING['price_elasticity']}),
e AS (SELECT product_category, {xavg('elasticity_coefficient')} AS e FROM price_elasticity GROUP BY 1),
g AS (SELECT p.p_partkey, p.p_type, p.p_retailprice AS p0, e.e, CAST(i AS BIGINT) AS i,
             ROUND(p.p_retailprice * (CAST({start!r} AS DOUBLE) + CAST({step!r} AS DOUBLE) * i), 2) AS price
      FROM part p LEFT JOIN e ON p.p_type = e.product_category, range(0, {n}) r(i)),
pr AS (SELECT *, ROUND((price - p0 * CAST({COST_SHARE!r} AS DOUBLE)) * pow(price / p0, -e), 6) AS profit FROM g),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY profit DESC, price DESC) AS rn FROM pr) t
         WHERE rn = 1),
opt AS (
  SELECT p_partkey, p_type, p0 AS base_price, ROUND(e, 6) AS elasticity, IF(e IS NULL, NULL, price) AS best_price,
         ROUND(profit / (p0 - p0 * CAST({COST_SHARE!r} AS DOUBLE)), 6) AS profit_index,
         IF(e IS NULL, NULL, ROUND(100.0 * (price - p0 * CAST({COST_SHARE!r} AS DOUBLE)) / price, 4)) AS margin_pct
  FROM best)"""


def optimal_prices() -> str:
    return "WITH" + _optimal_cte() + "\nSELECT * FROM opt"


def brand_share() -> str:
    return f"""
WITH {GEO},
b AS (
  SELECT g.r_name AS market, CAST(year(o.o_orderdate) AS INTEGER) AS year, p.p_brand AS brand,
         SUM(CAST(ROUND(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)) AS revenue_c
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN geo g ON c.c_nationkey = g.n_nationkey GROUP BY 1, 2, 3),
s AS (SELECT *, revenue_c / SUM(revenue_c) OVER (PARTITION BY market, year) AS share FROM b)
SELECT market, year, brand, revenue_c / 100.0 AS revenue_usd, CAST(share AS DOUBLE) AS share,
       CAST(share - LAG(share) OVER (PARTITION BY market, brand ORDER BY year) AS DOUBLE) AS share_change
FROM s"""


def product_competitor_prices() -> str:
    return f"""
WITH {CT},
pc AS (SELECT product_category, COUNT(*) AS observations, COUNT(DISTINCT competitor) AS competitors,
              {xavg('competitor_price_usd')} AS avg_competitor_price, {xavg('price_gap_pct')} AS avg_price_gap_pct
       FROM competitor_tracking GROUP BY 1)
SELECT p.p_partkey, p.p_type AS product_category, COALESCE(observations, 0) AS observations, COALESCE(competitors, 0) AS competitors,
       ROUND(avg_competitor_price, 2) AS avg_competitor_price, ROUND(avg_price_gap_pct, 2) AS avg_price_gap_pct
FROM (SELECT DISTINCT p_partkey FROM part) w JOIN part p ON w.p_partkey = p.p_partkey
LEFT JOIN pc ON p.p_type = pc.product_category"""


def product_supplier_performance() -> str:
    return "WITH" + _scorecard_cte() + """,
pairs AS (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS supplier_key FROM lineitem
          WHERE l_partkey IN (SELECT p_partkey FROM part))
SELECT w.p_partkey, pairs.supplier_key, volume, return_rate, score
FROM (SELECT DISTINCT p_partkey FROM part) w LEFT JOIN (pairs JOIN card ON pairs.supplier_key = card.supplier_key) ON w.p_partkey = pairs.p_partkey"""


def product_optimal_price() -> str:
    return "WITH" + _optimal_cte() + "\nSELECT * FROM opt WHERE p_partkey IN (SELECT p_partkey FROM part)"


def brand_rollup() -> str:
    return f"""
WITH {CT},
u AS (SELECT CASE WHEN brand_positioning = 'Value' THEN 'value_line' ELSE 'premium_line' END AS brand,
             market, competitor, price_gap_pct, promotion_flag FROM competitor_tracking)
SELECT brand, market, CAST(GROUPING_ID(brand, market) AS BIGINT) AS level, COUNT(*) AS observations,
       COUNT(DISTINCT competitor) AS competitors, ROUND({xavg('price_gap_pct')}, 4) AS avg_price_gap_pct,
       COUNT(CASE WHEN promotion_flag = 'TRUE' THEN 1 END) AS promotions
FROM u GROUP BY ROLLUP (brand, market)"""


def price_rule_table() -> str:
    """Same rules as a table: range join, lowest priority wins (ties by rule id)."""
    vals = ", ".join(f"({p}, '{rule}', CAST({low!r} AS DOUBLE), CAST({high!r} AS DOUBLE), {small}, {large}, CAST({change!r} AS DOUBLE))"
                     for p, rule, low, high, small, large, change in PRICE_RULES)
    return f"""
WITH rules(priority, rule_id, min_price, max_price, min_size, max_size, adjustment_pct) AS (VALUES {vals}),
m AS (SELECT p.p_partkey, r.rule_id, r.adjustment_pct,
             ROW_NUMBER() OVER (PARTITION BY p.p_partkey ORDER BY r.priority, r.rule_id) AS rn
      FROM part p JOIN rules r ON p.p_retailprice >= r.min_price AND p.p_retailprice < r.max_price
                              AND p.p_size BETWEEN r.min_size AND r.max_size)
SELECT p.p_partkey, p.p_type, p.p_size, p.p_retailprice, COALESCE(m.rule_id, 'none') AS rule_id,
       ROUND(p.p_retailprice * (CAST(1.0 AS DOUBLE) + COALESCE(m.adjustment_pct, CAST(0.0 AS DOUBLE)) / CAST(100.0 AS DOUBLE)), 2)
         AS new_price
FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey AND m.rn = 1"""


TIER_B = {
    "tb_quality_trend": quality_trend,
    "tb_delivery_performance": delivery_performance,
    "tb_budget_variance": budget_variance,
    "tb_supplier_scorecard": supplier_scorecard,
    "tb_shipping_cost": shipping_cost,
    "tb_production_plan": production_plan,
    "tb_production_plan_given": production_plan_given,
    "tb_price_rule_table_large": price_rule_table_large,
    "tb_market_rules": market_rules,
    "tb_capacity_plan": capacity_plan,
    "tb_price_monitor": price_monitor,
    "tb_market_entries": market_entries,
    "tb_market_forecast": market_forecast,
    "tb_seasonal_forecast": seasonal_forecast,
    "tb_price_rules": price_rules,
    "tb_price_rule_table": price_rule_table,
    "tb_elasticity_curves": elasticity_curves,
    "tb_optimal_prices": optimal_prices,
    "tb_brand_share": brand_share,
    "tb_product_competitor_prices": product_competitor_prices,
    "tb_product_supplier_performance": product_supplier_performance,
    "tb_product_optimal_price": product_optimal_price,
    "tb_brand_rollup": brand_rollup,
}


def price_stream() -> str:
    """Batch form of the stream: windows the final watermark (max event time - 2 h) has closed."""
    return f"""
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_type, value FROM events),
g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS events,
             CAST(ROUND(CAST(CAST({xavg('value')} AS VARCHAR) AS DECIMAL(38,17)), 9) AS DOUBLE) AS mean_value
      FROM e GROUP BY 1, 2)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, events, mean_value
FROM g WHERE window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM e) - INTERVAL 2 HOUR"""


TIER_B["tb_price_stream"] = price_stream


def rounding_on_text(sql: str) -> str:
    """Every ``ROUND(x, n)`` on the decimal text of x: Spark rounds the printed value, DuckDB the binary one."""
    out, rest = "", sql
    while "ROUND(" in rest:
        head, _, rest = rest.partition("ROUND(")
        depth, commas = 1, []
        for k, ch in enumerate(rest):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                commas.append(k)
            if depth == 0:
                break
        inner, rest = rest[:k], rest[k + 1:]
        if commas:
            value, places = rounding_on_text(inner[:commas[-1]]), inner[commas[-1] + 1:].strip()
            out += f"{head}CAST(ROUND_(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,17)), {places}) AS DOUBLE)"
        else:
            out += f"{head}ROUND_({rounding_on_text(inner)})"
    return out + rest


def tier_b() -> dict[str, str]:
    return {name: rounding_on_text(build()).replace("ROUND_(", "ROUND(") for name, build in TIER_B.items()}
