"""Pricing analytics beyond the four reports (Tier B: advertised, never coded).

Definitions are ours and stated per function; none claims to match the
reference.  Averages are exact decimal sums over counts and money is summed in
integer cents, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.config import DateWindow
from marketlens.functions import count_if, exact_avg, exact_sum
from marketlens.operators.box_index import best_boxes
from marketlens.plans.supply import supplier_scorecard
from marketlens.session import dealt, materialize
from marketlens.sources import derived
from marketlens.sources.derived import geo_of


def _month(c: str) -> Column:
    return F.trunc(F.col(c), "month")



# ---- TB-6 competitor price monitoring ------------------------------------------

def price_monitor(tracking: DataFrame) -> DataFrame:
    """Per competitor, market and month: observations, mean competitor price,
    the previous observed month's mean and the change in percent."""
    monthly = tracking.groupBy("competitor", "market", _month("tracking_date").alias("month")).agg(
        F.count(F.lit(1)).alias("observations"), F.round(exact_avg("competitor_price_usd"), 9).alias("avg_price"))
    w = Window.partitionBy("competitor", "market").orderBy("month")
    prev = F.lag("avg_price").over(w)
    return (monthly.withColumn("prev_avg_price", prev)
            .withColumn("change_pct", F.lit(100.0) * (F.col("avg_price") - F.col("prev_avg_price"))
                        / F.nullif(F.col("prev_avg_price"), F.lit(0.0))))


def market_entries(tracking: DataFrame) -> DataFrame:
    """Per market and month: competitors seen, entrants (not seen the calendar month before)
    and leavers (seen the month before, not this month).  Only months between the first and
    the last observed one count, so nobody enters in the first month or leaves after the last.

    One scan: each (market, competitor) looks at its own previous and next month."""
    seen = materialize(tracking.select("market", _month("tracking_date").alias("month"), "competitor").distinct(), "market-months")
    first, last = seen.agg(F.min("month"), F.max("month")).first()  # two dates
    w = Window.partitionBy("market", "competitor").orderBy("month")
    after = F.add_months("month", 1)
    flagged = seen.select(
        "market", "month", after.alias("after"),
        (~F.lag("month").over(w).eqNullSafe(F.add_months("month", -1)) & (F.col("month") > F.lit(first))).alias("entered"),
        (~F.lead("month").over(w).eqNullSafe(after) & (after <= F.lit(last))).alias("left"))
    none = F.lit(0)
    here = F.struct(F.col("month").alias("month"), F.lit(1).alias("n"), F.col("entered").cast("int").alias("e"), none.alias("l"))
    gone = F.struct(F.col("after").alias("month"), none.alias("n"), none.alias("e"), F.lit(1).alias("l"))
    events = flagged.select("market", F.explode(F.when(F.col("left"), F.array(here, gone)).otherwise(F.array(here))).alias("x"))
    return events.groupBy("market", F.col("x.month").alias("month")).agg(
        F.sum("x.n").alias("competitors"), F.sum("x.e").alias("entrants"), F.sum("x.l").alias("leavers"))


# ---- TB-7 market trend and forecast --------------------------------------------

def market_forecast(tracking: DataFrame, horizon: int = 3) -> DataFrame:
    """Per market: monthly mean competitor price, a least-squares line over the
    month index (months since 1970-01), a seasonal index per calendar month
    (mean of that month's means / mean of all monthly means), and forecasts for
    the ``horizon`` months after the last one: line value x seasonal index.

    The line is fitted from exact decimal sums, so every engine and every
    partitioning gives the same coefficients; outputs are rounded to 4 places.
    """
    # the fit, the seasonal index and the mean all read this small table: written once
    monthly = materialize(tracking.groupBy("market", _month("tracking_date").alias("month")).agg(
        exact_avg("competitor_price_usd").alias("y")), "market-months")
    t = (F.year("month") - 1970) * 12 + F.month("month") - 1
    pts = monthly.withColumn("t", t.cast("bigint"))
    d = "decimal(38,6)"  # sums of y and y*t at 6 places: exact, engine-independent
    fit = pts.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("t")).alias("st"),
        F.sum(F.col("t") * F.col("t")).alias("stt"),
        F.sum(F.col("y").cast(d)).cast("double").alias("sy"),
        F.sum((F.col("y") * F.col("t")).cast(d)).cast("double").alias("sty"),
        F.max("t").alias("t_last"),
    )
    den = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = F.when(den != 0, (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / den).otherwise(F.lit(0.0))
    fit = fit.withColumn("slope", slope).withColumn(
        "intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("n"))
    seasonal = pts.groupBy("market", F.month("month").alias("cal_month")).agg(exact_avg("y").alias("m_mean"))
    overall = pts.groupBy("market").agg(exact_avg("y").alias("all_mean"))
    seasonal = seasonal.join(overall, "market").select(
        "market", "cal_month", (F.col("m_mean") / F.col("all_mean")).alias("seasonal_index"))
    steps = fit.select("market", "slope", "intercept", "t_last",
                       F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    t_next = F.col("t_last") + F.col("h")
    ahead = steps.select(
        "market", "h", "slope", "intercept",
        F.make_date((t_next / 12).cast("int") + 1970, (t_next % 12).cast("int") + 1, F.lit(1)).alias("month"),
        (F.col("intercept") + F.col("slope") * t_next).alias("trend"),
        ((t_next % 12) + 1).cast("int").alias("cal_month"))
    out = ahead.join(seasonal, ["market", "cal_month"], "left")
    idx = F.coalesce(F.col("seasonal_index"), F.lit(1.0))
    return out.select(
        "market", F.col("h").alias("horizon"), "month",
        F.round("slope", 4).alias("slope"), F.round("trend", 4).alias("trend"),
        F.round(idx, 4).alias("seasonal_index"), F.round(F.col("trend") * idx, 4).alias("forecast"))


# ---- TB-8 dynamic pricing rules -------------------------------------------------

@dataclass(frozen=True)
class PriceRule:
    priority: int
    rule_id: str
    min_price: float
    max_price: float
    min_size: int
    max_size: int
    adjustment_pct: float


# Our default rule set (lowest priority number wins when several match).
DEFAULT_RULES: tuple[PriceRule, ...] = (
    PriceRule(1, "clearance_small", 0.0, 1000.0, 1, 5, -15.0),
    PriceRule(2, "premium_large", 1800.0, 1e12, 40, 50, 8.0),
    PriceRule(3, "budget_band", 0.0, 1000.0, 1, 50, -5.0),
    PriceRule(4, "mid_band", 1000.0, 1500.0, 1, 50, 2.0),
    PriceRule(5, "upper_band", 1500.0, 1e12, 1, 50, 4.0),
)


def apply_price_rules(tables: Mapping[str, DataFrame], rules: Sequence[PriceRule] = DEFAULT_RULES) -> DataFrame:
    """Per part: the winning rule (range match on price [min, max) and size
    [min, max], lowest priority number first) and the adjusted price.

    The rule list is a handful of literals, so matching is a CASE chain in one
    projection: no join, no shuffle, whatever the number of parts."""
    part = tables["part"].select("p_partkey", "p_type", "p_size", "p_retailprice")
    price, size = F.col("p_retailprice"), F.col("p_size")
    rule_id, adj = None, None
    for r in sorted(rules, key=lambda r: r.priority):
        cond = (price >= r.min_price) & (price < r.max_price) & size.between(r.min_size, r.max_size)
        rule_id = F.when(cond, F.lit(r.rule_id)) if rule_id is None else rule_id.when(cond, F.lit(r.rule_id))
        adj = F.when(cond, F.lit(r.adjustment_pct)) if adj is None else adj.when(cond, F.lit(r.adjustment_pct))
    rule_id = rule_id.otherwise(F.lit("none"))
    adj = adj.otherwise(F.lit(0.0))
    return part.select("p_partkey", "p_type", "p_size", "p_retailprice", rule_id.alias("rule_id"),
                       F.round(price * (F.lit(1.0) + adj / F.lit(100.0)), 2).alias("new_price"))


RULES_SCHEMA = ("priority int, rule_id string, min_price double, max_price double, min_size int, max_size int, "
                "adjustment_pct double")
# Market conditions of a rule, optional: gap to the competitors in percent, and units sold; half-open, NULL is open.
MARKET_BOUNDS = ("min_gap", "max_gap", "min_demand", "max_demand")


def rules_frame(spark, rules: Sequence[PriceRule] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(r.priority, r.rule_id, r.min_price, r.max_price, r.min_size, r.max_size,
                                   r.adjustment_pct) for r in rules], RULES_SCHEMA)


def rules_from_parts(parts: DataFrame) -> DataFrame:
    """A rule table that grows with the catalogue: each part asks for a price band around its own list price,
    every seventh one with an open upper end that an outlier price of 1e12 closes."""
    price, size, key = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    return parts.select(
        (key % 997).cast("int").alias("priority"), F.concat(F.lit("band_"), key.cast("string")).alias("rule_id"),
        F.round(price - key % 40, 2).alias("min_price"), F.when(key % 7 == 0, F.lit(1e12)).otherwise(F.round(price + key % 25, 2)).alias("max_price"),
        (size - key % 3).cast("int").alias("min_size"), (size + key % 5).cast("int").alias("max_size"),
        ((key % 31) - 15).cast("double").alias("adjustment_pct"))


def market_conditions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per part: ``gap``, the mean price gap to the competitors of its category in percent (whole hundredths), and
    ``demand``, the units sold of the part."""
    gaps = derived.competitor_tracking(tables).groupBy("product_category").agg(F.round(exact_avg("price_gap_pct"), 2).alias("gap"))
    sold = tables["lineitem"].groupBy("l_partkey").agg(exact_sum("l_quantity").alias("demand"))
    part = tables["part"].select("p_partkey", "p_type", "p_size", "p_retailprice")
    out = part.join(gaps, F.col("p_type") == F.col("product_category"), "left").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select("p_partkey", "p_type", "p_size", "p_retailprice", "gap", F.coalesce("demand", F.lit(0.0)).alias("demand"))


# Our market rules: name, priority, change in percent, gap from and to, demand from and to.
MARKET_RULES = (("raise", 0, 5.0, None, 0.0, 150.0, None), ("match", 10, -8.0, 5.0, None, None, None), ("clear", 20, -12.0, None, None, None, 60.0))


def market_rules(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A rule table over market conditions, ``MARKET_RULES`` once a category with a price floor and priority of
    its own: raise the price where the category is not above its competitors and the part sells, lower it where the
    category is above them, or where the part does not sell."""
    kinds = tables["part"].select("p_type", (F.length("p_type") * 37 + F.ascii("p_type")).cast("bigint").alias("h")).distinct()

    def rule(name, priority, change, *bounds):
        market = [F.lit(v).cast("double").alias(c) for c, v in zip(MARKET_BOUNDS, bounds)]
        return F.struct((F.lit(priority) + F.col("h") % 10).cast("int").alias("priority"), F.concat(F.lit(f"{name}_"), F.col("p_type")).alias("rule_id"),
                        ((F.col("h") % 500) + 900).cast("double").alias("min_price"), F.lit(None).cast("double").alias("max_price"),
                        F.lit(1).alias("min_size"), F.lit(50).alias("max_size"), F.lit(change).alias("adjustment_pct"), *market)

    return kinds.select(F.explode(F.array(*[rule(*r) for r in MARKET_RULES])).alias("r")).select("r.*")


def apply_price_rule_table(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """TB-8 over a rules *table* (range join; lowest priority number wins per part, then the smaller id).

    A part matches a rule when min_price <= price < max_price and min_size <= size <= max_size, and, where the rules
    have the columns of ``MARKET_BOUNDS`` and the parts ``gap`` and ``demand``, when these lie in [min, max) too.
    NULL bounds are open.  The distinct values are matched, through ``operators.box_index``, and
    the winners join back to the parts.  Parts with no match keep their price, rule_id 'none'.
    """
    dims = [("p_retailprice", "min_price", "max_price"), ("p_size", "min_size", "_end_size")]
    if set(MARKET_BOUNDS) <= set(rules.columns):
        dims += [("gap", "min_gap", "max_gap"), ("demand", "min_demand", "max_demand")]
    p = parts.select("p_partkey", "p_type", *[d[0] for d in dims])
    best = best_boxes(p, rules.withColumn("_end_size", F.col("max_size") + 1), dims, ["priority", "rule_id"], ["rule_id", "adjustment_pct"])
    best = best.withColumnsRenamed({d[0]: f"_{d[0]}" for d in dims})
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d[0]).cast("double").eqNullSafe(F.col(f"_{d[0]}"))
    out = p.join(best, same, "left")
    price, adj = F.col("p_retailprice"), F.coalesce(F.col("adjustment_pct"), F.lit(0.0))
    return out.select("p_partkey", "p_type", "p_size", "p_retailprice", F.coalesce(F.col("rule_id"), F.lit("none")).alias("rule_id"),
                      F.round(price * (F.lit(1.0) + adj / F.lit(100.0)), 2).alias("new_price"))


# ---- TB-9 elasticity curves ----------------------------------------------------

def elasticity_curves(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per customer region and part type: least-squares slope of ln(quantity) on
    ln(net unit price = extended price x (1 - discount) / quantity), its R^2 and
    the number of points.  ln values are rounded to 9 places and summed as exact
    decimals; slope and R^2 are rounded to 6 places."""
    li = tables["lineitem"].select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = tables["orders"].select("o_orderkey", "o_custkey")
    part = tables["part"].select("p_partkey", "p_type")
    cust = tables["customer"].select("c_custkey", "c_nationkey")
    geo = geo_of(tables)
    j = (li.where((F.col("l_quantity") > 0) & (F.col("l_extendedprice") > 0) & (F.col("l_discount") < 1))
         .join(orders, li.l_orderkey == orders.o_orderkey)
         .join(part, li.l_partkey == part.p_partkey)
         .join(cust, orders.o_custkey == cust.c_custkey)
         .join(geo, cust.c_nationkey == geo.n_nationkey))
    x = F.round(F.log(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) / F.col("l_quantity")), 9)
    y = F.round(F.log(F.col("l_quantity")), 9)
    pts = j.select(F.col("r_name").alias("market"), F.col("p_type").alias("product_category"),
                   x.cast("decimal(18,9)").alias("x"), y.cast("decimal(18,9)").alias("y"))
    s = pts.groupBy("market", "product_category").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("x").cast("double").alias("sx"), F.sum("y").cast("double").alias("sy"),
        F.sum(F.col("x") * F.col("x")).cast("double").alias("sxx"),
        F.sum(F.col("y") * F.col("y")).cast("double").alias("syy"),
        F.sum(F.col("x") * F.col("y")).cast("double").alias("sxy"))
    n = F.col("points")
    vx = n * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = n * F.col("syy") - F.col("sy") * F.col("sy")
    cxy = n * F.col("sxy") - F.col("sx") * F.col("sy")
    slope = F.when(vx > 0, cxy / vx)
    r2 = F.when((vx > 0) & (vy > 0), cxy * cxy / (vx * vy))
    return s.select("market", "product_category", "points",
                    F.round(slope, 6).alias("elasticity_slope"), F.round(r2, 6).alias("r_squared"))


# ---- TB-10 margin optimisation -------------------------------------------------

COST_SHARE = 0.6          # unit cost as a share of the list price (our assumption)
GRID = (0.80, 0.05, 9)    # price grid: list price x (0.80, 0.85, ..., 1.20)


def optimal_prices(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per part: elasticity e of its category (exact mean elasticity coefficient
    of the price-elasticity table, all dates), demand (p / p0)^-e, unit cost
    0.6 p0, and the grid price maximising (p - cost) x demand.  The grid is an
    array evaluated per row (no explode, no shuffle per part).  A part of a category
    without observations is kept, with NULL results."""
    pe = derived.price_elasticity(tables)
    e_cat = pe.groupBy("product_category").agg(exact_avg("elasticity_coefficient").alias("e"))
    part = tables["part"].select("p_partkey", "p_type", "p_retailprice")
    j = part.join(e_cat, part.p_type == e_cat.product_category, "left")
    p0, e = F.col("p_retailprice"), F.col("e")
    cost = p0 * F.lit(COST_SHARE)
    start, step, n = GRID

    def candidate(i):
        price = F.round(p0 * (F.lit(start) + F.lit(step) * i), 2)
        profit = (price - cost) * F.pow(price / p0, -e)
        return F.struct(F.round(profit, 6).alias("profit"), price.alias("price"))

    best = F.when(e.isNotNull(), F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), candidate)))
    base_profit = (p0 - cost)
    return j.select(
        "p_partkey", "p_type", F.col("p_retailprice").alias("base_price"), F.round(e, 6).alias("elasticity"),
        best["price"].alias("best_price"),
        F.round(best["profit"] / base_profit, 6).alias("profit_index"),
        F.round(F.lit(100.0) * (best["price"] - cost) / best["price"], 4).alias("margin_pct"))


# ---- TB-11 revenue share by brand ----------------------------------------------

def brand_share(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per customer region, order year and part brand: net revenue (cents summed
    exactly), its share of the region-year, and the change of share against the
    brand's previous year in that region."""
    li = tables["lineitem"].select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate")
    part = tables["part"].select("p_partkey", "p_brand")
    cust = tables["customer"].select("c_custkey", "c_nationkey")
    geo = geo_of(tables)
    cents = F.round(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) * F.lit(100), 0).cast("bigint")
    per = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .join(part, li.l_partkey == part.p_partkey)
           .groupBy("o_custkey", F.year("o_orderdate").alias("year"), "p_brand").agg(F.sum(cents).alias("c")))
    by_brand = (per.join(cust, per.o_custkey == cust.c_custkey).join(geo, F.col("c_nationkey") == geo.n_nationkey)
                .groupBy(F.col("r_name").alias("market"), "year", F.col("p_brand").alias("brand"))
                .agg(F.sum("c").alias("revenue_c")))
    share = F.col("revenue_c") / F.sum("revenue_c").over(Window.partitionBy("market", "year"))
    w = Window.partitionBy("market", "brand").orderBy("year")
    return (by_brand.withColumn("revenue_usd", F.col("revenue_c") / F.lit(100.0))
            .withColumn("share", share)
            .withColumn("share_change", F.col("share") - F.lag("share").over(w))
            .drop("revenue_c"))


# ---- TB-12 product lookups -------------------------------------------------------

def competitor_prices_for(products: DataFrame, tables: Mapping[str, DataFrame], category: str | None = None,
                          window: DateWindow | None = None) -> DataFrame:
    """get_competitor_prices: for each product id (p_partkey) its category (or the given one)
    and the category's competitor picture over all dates, or a window: observations, competitors,
    mean competitor price and mean price gap.  An unknown id or category keeps its row, with NULLs."""
    tracking = derived.competitor_tracking(tables)
    if window is not None:
        tracking = tracking.where(window.contains(F.col("tracking_date")))
    per_cat = tracking.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("observations"), F.count_distinct("competitor").alias("competitors"),
        exact_avg("competitor_price_usd").alias("avg_competitor_price"),
        exact_avg("price_gap_pct").alias("avg_price_gap_pct"))
    part = tables["part"].select("p_partkey", F.col("p_type").alias("wanted"))
    wanted = products.select("p_partkey").distinct().join(part, "p_partkey", "left")
    if category is not None:
        wanted = wanted.withColumn("wanted", F.lit(category))
    out = wanted.join(per_cat, F.col("wanted") == per_cat.product_category, "left")
    return out.select("p_partkey", F.col("wanted").alias("product_category"), F.coalesce("observations", F.lit(0)).alias("observations"),
                      F.coalesce("competitors", F.lit(0)).alias("competitors"),
                      F.round("avg_competitor_price", 2).alias("avg_competitor_price"),
                      F.round("avg_price_gap_pct", 2).alias("avg_price_gap_pct"))


SUPPLIER_METRICS = ("volume", "return_rate", "score")


def supplier_performance_for(products: DataFrame, tables: Mapping[str, DataFrame],
                             metrics: Sequence[str] = SUPPLIER_METRICS) -> DataFrame:
    """get_supplier_performance: for each product id the suppliers that shipped it
    (distinct), with the wanted scorecard metrics.  An id nobody shipped keeps its row, with NULLs.
    The lines of the wanted ids are dealt out by pair, so no task holds more pairs as the table grows."""
    card = supplier_scorecard(tables)
    unknown = [m for m in metrics if m not in card.columns or m == "supplier_key"]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; choose from {[c for c in card.columns if c != 'supplier_key']}")
    li = tables["lineitem"].select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("supplier_key"))
    ids = products.select("p_partkey").distinct()
    lines = dealt(li.join(ids, "p_partkey", "left_semi").filter("supplier_key is not null"), tables["lineitem"].count(), "p_partkey", "supplier_key")
    pairs = lines.distinct().join(card, "supplier_key")
    return ids.join(pairs, "p_partkey", "left").select("p_partkey", "supplier_key", *metrics)


def optimal_price_for(products: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """calculate_optimal_price: the TB-10 result for the given product ids; an unknown id keeps its row, with NULLs."""
    return products.select("p_partkey").distinct().join(optimal_prices(tables), "p_partkey", "left")


# ---- TB-13 several brands in one platform ----------------------------------------

def brand_rollup(tracking: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """Totals per brand and market, per brand, and across brands (rollup) of competitor tables.

    ``tracking`` is one table with a ``brand`` column, or a table per brand.  Rows are first
    summed per (brand, market, competitor); the rollup and its distinct count read that.
    """
    cols = ("brand", "market", "competitor", "price_gap_pct", "promotion_flag")
    if not isinstance(tracking, DataFrame):
        frames = [df.withColumn("brand", F.lit(b)).select(*cols) for b, df in tracking.items()]
        tracking = reduce(DataFrame.unionByName, frames)
    small = tracking.groupBy("brand", "market", "competitor").agg(
        F.count(F.lit(1)).alias("n"), exact_sum("price_gap_pct").alias("gap"), F.count("price_gap_pct").alias("gap_n"),
        count_if(F.col("promotion_flag") == "TRUE").alias("promo"))
    return small.rollup("brand", "market").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("n").alias("observations"),
        F.count_distinct("competitor").alias("competitors"),
        F.round(exact_sum("gap") / F.nullif(F.sum("gap_n"), F.lit(0)), 4).alias("avg_price_gap_pct"),
        F.sum("promo").alias("promotions"))


def brand_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Our two-brand split of the driver's data, tagged in one pass: the value line and the
    premium / mid-tier line."""
    line = F.when(F.col("brand_positioning") == "Value", "value_line").otherwise("premium_line")
    return derived.competitor_tracking(tables).withColumn("brand", line)
