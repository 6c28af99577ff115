"""DuckDB oracle SQL for every registered query.

The four reports are generated from tables of facts: columns, measures, rank keys and
ladders (``SUBJECTS`` below; texts in ``fixed_values``).  The method differs from the
library's: measures are window aggregates beside each row instead of a rollup and a join,
a rank is one plus the number of rows with a better key, averages are compensated sums
(``favg``), and a segment is a distinct row of those windows.  Nothing is imported from the library.

Engine differences are spelled out: NULL order, BIGINT ranks, rounding of the decimal text
half away from zero, and all output columns as a tie-break before LIMIT.
"""

from __future__ import annotations

from dataclasses import dataclass

from oracle.fixed_values import ALIASES, DEFAULT_INTENT, KEYWORDS, LABELS
from oracle.mapping import MAPPING

STUDY = ("1998-01-01", "1998-12-31")
REFERENCE = ("2024-12-14", "2024-12-15")
REPORT_LIMIT = 100
HIGHEST_LIMIT = 500  # a larger wish is cut to it


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rounded(expr: str, places: int) -> str:
    """Half away from zero on the shortest decimal text of a double, as Spark rounds."""
    return f"CAST(ROUND(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,17)), {places}) AS DOUBLE)"


def over(kind: str, arg: str, keys: tuple[str, ...]) -> str:
    """A measure as a window aggregate over the row's segment."""
    segment = f"OVER (PARTITION BY {', '.join(keys)})"
    return {
        "rows": f"COUNT(*) {segment}",
        "distinct": f"COUNT(DISTINCT {arg}) {segment}",
        "mean": f"ROUND(favg({arg}) {segment}, 9)",
        "total": f"ROUND(fsum({arg}) {segment}, 6)",
        "whole": f"CAST(SUM({arg}) {segment} AS BIGINT)",
        "having": f"COUNT(*) FILTER ({arg}) {segment}",
        "most": f"MAX({arg}) {segment}",
        "least": f"MIN({arg}) {segment}",
    }[kind]


def better(keys: str, within: str = "") -> str:
    """RANK as one plus the rows that stand strictly before the row's peers."""
    part = f"PARTITION BY {within} " if within else ""
    return f"CAST(1 + COUNT(*) OVER ({part}ORDER BY {keys} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT)"


def ladder(column: str, conditions: list[str]) -> str:
    """First condition that holds gives its text, else the last text."""
    *texts, default = LABELS[column]
    assert len(texts) == len(conditions), column
    steps = ", ".join(f"IF({c}, {text(t)}, NULL)" for c, t in zip(conditions, texts))
    label = f"COALESCE({steps}, {text(default)})"
    # the plain code: the label's letters in lower case, runs of anything else as one underscore
    code = f"regexp_replace(regexp_replace(lower({label}), '[^a-z]+', '_', 'g'), '^_|_$', '', 'g')"
    return f"{label} AS {column}, {code} AS {column}_code"


def bounds(column: str, source: str, floors: list[float]) -> tuple[str, list[str]]:
    """A ladder over one number: at or above each floor, highest first."""
    return column, [f"{source} >= {f}" for f in floors]


@dataclass(frozen=True)
class Subject:
    name: str                      # query_type
    fact: str                      # mapping entry
    day: str                       # SQL of the row's date
    open_end: bool                 # the window's end is ignored
    keys: tuple[str, ...]
    extra: dict[str, str]          # columns computed on each row
    measures: dict[str, tuple[str, str]]
    after: dict[str, str]          # columns computed from measures
    ranks: dict[str, tuple[str, str]]  # name -> (order, partition)
    shown: list[tuple[str, str, int | None]]  # output column, source, places
    segment: list[tuple[str, str, int | None]]
    ladders: list[tuple[str, list[str]]]
    order: str
    rank_view: list[str]


def up(c: str) -> str:
    return f"{c} ASC NULLS FIRST"


def down(c: str) -> str:
    return f"{c} DESC NULLS LAST"


def plain(*names: str) -> list[tuple[str, str, None]]:
    return [(n, n, None) for n in names]


GOOD_IMPACT = "market_share_impact IN ('Positive', 'Very Positive')"
_CT_SEGMENT = [*plain("competitors_tracked"), ("market_avg_price_gap", "avg_gap", 1),
               *plain("positive_positioning_count", "competitor_promotions_active", "price_advantages", "price_disadvantages"),
               ("market_avg_own_price", "avg_own", 2), ("market_avg_competitor_price", "avg_competitor", 2)]
_CP_SEGMENT = [*plain("campaigns_executed"), ("segment_avg_roi", "avg_roi", 1), ("segment_avg_discount", "avg_discount", 1),
               ("segment_total_revenue", "revenue", 2), ("segment_total_cost", "cost", 2), *plain("total_new_customers"),
               ("segment_avg_repeat_rate", "avg_repeat", 1), *plain("total_units_sold"), ("segment_revenue_cost_ratio", "revenue_per_cost", 2),
               ("segment_cost_per_acquisition", "customers_per_thousand", 2), ("segment_acquisitions_per_1000_usd", "customers_per_thousand", 2),
               ("segment_true_cost_per_acquisition", "cost_per_customer", 2)]
_PE_SEGMENT = [("segment_avg_elasticity", "avg_elasticity", 2), *plain("price_points_tested"), ("segment_avg_revenue_impact", "avg_revenue", 1),
               ("segment_avg_margin_impact", "avg_margin", 1),
               *plain("price_increase_recommendations", "price_decrease_recommendations", "maintain_price_recommendations"),
               ("segment_avg_optimal_price", "avg_optimal", 2), ("segment_max_revenue_impact", "most_revenue", 1), ("segment_min_revenue_impact", "least_revenue", 1)]
_PC_SEGMENT = [*plain("planned_campaigns"), ("market_total_budget", "budget", 2), ("market_avg_expected_uplift", "avg_uplift", 1),
               ("market_avg_discount", "avg_discount", 1), ("market_avg_duration_days", "avg_days", 0),
               *plain("high_competition_campaigns", "high_impact_campaigns", "channels_utilized", "audience_segments"),
               ("market_max_uplift", "most_uplift", 1), ("market_min_budget", "least_budget", 2), ("market_max_budget", "most_budget", 2)]

SUBJECTS = {
    "competitor": Subject(
        "competitor_tracking", "competitor_tracking", "tracking_date", False, ("market", "product_category"), {},
        {"competitors_tracked": ("distinct", "competitor"), "avg_gap": ("mean", "price_gap_pct"),
         "positive_positioning_count": ("having", GOOD_IMPACT), "competitor_promotions_active": ("having", "promotion_flag = 'TRUE'"),
         "price_advantages": ("having", "price_gap_pct <= -15"), "price_disadvantages": ("having", "price_gap_pct >= 10"),
         "avg_own": ("mean", "own_price_usd"), "avg_competitor": ("mean", "competitor_price_usd")},
        {},
        {"price_competitiveness_rank": (up("price_gap_pct"), "market"), "overall_competitiveness_rank": (up("abs(price_gap_pct)"), "")},
        [*plain("tracking_date", "competitor", "product_category", "market", "own_price_usd", "competitor_price_usd"),
         ("price_gap_pct", "price_gap_pct", 1), *plain("promotion_flag", "quality_comparison", "brand_positioning", "market_share_impact"),
         *_CT_SEGMENT, *plain("price_competitiveness_rank", "overall_competitiveness_rank")],
        _CT_SEGMENT,
        [("competitive_position", ["price_gap_pct <= -30 AND market_share_impact = 'Very Positive'", f"price_gap_pct <= -15 AND {GOOD_IMPACT}",
                                   "abs(price_gap_pct) <= 15", "price_gap_pct >= 10"]),
         ("promotional_environment", ["promotion_flag = 'TRUE' AND price_gap_pct >= 0", "promotion_flag = 'TRUE'"]),
         ("value_proposition", ["quality_comparison = 'Superior' AND price_gap_pct <= 0", "quality_comparison = 'Superior'", "quality_comparison = 'Comparable'"]),
         ("brand_position_strength", ["brand_positioning = 'Premium' AND market_share_impact = 'Very Positive'", "brand_positioning = 'Premium'", "brand_positioning = 'Mid-tier'"])],
        f"{down('tracking_date')}, {down('abs(price_gap_pct)')}",
        ["tracking_date", "competitor", "product_category", "market", "price_gap_pct"]),
    "campaign": Subject(
        "campaign_performance", "campaign_performance", "campaign_date", False, ("campaign_type", "target_audience", "market_segment"), {},
        {"campaigns_executed": ("rows", ""), "avg_roi": ("mean", "roi_pct"), "avg_discount": ("mean", "discount_pct"), "revenue": ("total", "revenue_generated"),
         "cost": ("total", "campaign_cost"), "total_new_customers": ("whole", "customer_acquisition"), "avg_repeat": ("mean", "repeat_purchase_rate"),
         "total_units_sold": ("whole", "units_sold")},
        {"revenue_per_cost": "revenue / NULLIF(cost, 0)", "customers_per_thousand": "total_new_customers / NULLIF(cost, 0) * 1000",
         "cost_per_customer": "cost / NULLIF(CAST(total_new_customers AS DOUBLE), 0)"},
        {"roi_rank": (down("avg_roi"), ""), "revenue_rank": (down("revenue"), ""), "efficiency_rank": (up("customers_per_thousand"), "")},
        [*plain("campaign_date", "campaign_name", "campaign_type", "target_audience", "market_segment", "discount_pct", "original_price_usd",
                "campaign_price_usd", "units_sold"), ("revenue_generated", "revenue_generated", 2), ("campaign_cost", "campaign_cost", 2), ("roi_pct", "roi_pct", 1),
         *plain("customer_acquisition"), ("repeat_purchase_rate", "repeat_purchase_rate", 1), *_CP_SEGMENT, *plain("roi_rank", "revenue_rank", "efficiency_rank")],
        _CP_SEGMENT,
        [bounds("campaign_performance_tier", "roi_pct", [500, 300, 200]),
         ("discount_efficiency", ["discount_pct >= 25 AND roi_pct >= 300", "discount_pct >= 25", "roi_pct >= 300"]),
         bounds("retention_performance", "repeat_purchase_rate", [60, 40, 25]),
         ("acquisition_effectiveness", [f"customer_acquisition >= 100 AND {rounded('customers_per_thousand', 2)} <= 50", "customer_acquisition >= 50", "customer_acquisition >= 20"])],
        f"{down('roi_pct')}, {down('revenue_generated')}",
        ["campaign_name", "campaign_type", "target_audience", "market_segment"]),
    "elasticity": Subject(
        "price_elasticity", "price_elasticity", "analysis_date", False, ("market", "product_category", "customer_segment"), {},
        {"avg_elasticity": ("mean", "elasticity_coefficient"), "price_points_tested": ("rows", ""), "avg_revenue": ("mean", "revenue_impact_pct"),
         "avg_margin": ("mean", "margin_impact_pct"), "price_increase_recommendations": ("having", "recommendation = 'Increase Price'"),
         "price_decrease_recommendations": ("having", "recommendation = 'Decrease Price'"), "maintain_price_recommendations": ("having", "recommendation = 'Maintain Price'"),
         "avg_optimal": ("mean", "optimal_price_usd"), "most_revenue": ("most", "revenue_impact_pct"), "least_revenue": ("least", "revenue_impact_pct")},
        {},
        {"revenue_impact_rank": (down("abs(revenue_impact_pct)"), ""), "market_sensitivity_rank": (down("elasticity_coefficient"), "market")},
        [*plain("analysis_date", "product_category", "market", "customer_segment", "price_point_usd", "demand_quantity"),
         ("elasticity_coefficient", "elasticity_coefficient", 2), *plain("sensitivity_level", "optimal_price_usd"), ("revenue_impact_pct", "revenue_impact_pct", 1),
         ("margin_impact_pct", "margin_impact_pct", 1), *plain("recommendation"), *_PE_SEGMENT, *plain("revenue_impact_rank", "market_sensitivity_rank")],
        _PE_SEGMENT,
        [bounds("sensitivity_classification", "elasticity_coefficient", [2, 1]),
         ("pricing_strategy", ["recommendation = 'Increase Price' AND revenue_impact_pct > 5", "recommendation = 'Increase Price'",
                               "recommendation = 'Decrease Price' AND revenue_impact_pct > 10", "recommendation = 'Decrease Price'"]),
         bounds("revenue_opportunity_level", "abs(revenue_impact_pct)", [15, 10, 5]),
         ("price_optimization_status", ["optimal_price_usd > price_point_usd * 1.1e0", "optimal_price_usd < price_point_usd * 0.9e0"])],
        f"{down('abs(revenue_impact_pct)')}, {down('elasticity_coefficient')}",
        ["analysis_date", "product_category", "market", "customer_segment", "elasticity_coefficient", "revenue_impact_pct"]),
    "promo": Subject(
        "promotional_calendar", "promotional_calendar", "CAST(start_date AS DATE)", True, ("target_market", "product_category"),
        {"campaign_duration_days": "CAST(CAST(end_date AS DATE) - CAST(start_date AS DATE) AS BIGINT)"},
        {"planned_campaigns": ("rows", ""), "budget": ("total", "budget_usd"), "avg_uplift": ("mean", "expected_uplift_pct"), "avg_discount": ("mean", "discount_value"),
         "avg_days": ("mean", "campaign_duration_days"), "high_competition_campaigns": ("having", "competitive_response = 'High'"),
         "high_impact_campaigns": ("having", "expected_uplift_pct >= 40"), "channels_utilized": ("distinct", "channel"), "audience_segments": ("distinct", "target_audience"),
         "most_uplift": ("most", "expected_uplift_pct"), "least_budget": ("least", "budget_usd"), "most_budget": ("most", "budget_usd")},
        {},
        {"impact_efficiency_rank": (f"{down('expected_uplift_pct')}, {up('budget_usd')}", ""), "market_priority_rank": (down("expected_uplift_pct"), "target_market")},
        [*plain("promo_id", "start_date", "end_date", "campaign_name", "target_market", "product_category", "discount_type", "discount_value", "min_purchase_usd",
                "target_audience", "expected_uplift_pct", "budget_usd", "channel", "seasonality_factor", "competitive_response", "campaign_duration_days"),
         *_PC_SEGMENT, *plain("impact_efficiency_rank", "market_priority_rank")],
        _PC_SEGMENT,
        [("campaign_priority_tier", ["expected_uplift_pct >= 40 AND budget_usd <= 20000", *bounds("", "expected_uplift_pct", [40, 30, 20])[1]]),
         ("competitive_intensity", ["competitive_response = 'High' AND expected_uplift_pct >= 35", "competitive_response = 'High'", "competitive_response = 'Medium'"]),
         ("discount_strategy", ["discount_type = 'Percentage' AND discount_value >= 30", "discount_type = 'Fixed Amount' AND discount_value >= 200", "discount_value >= 20"]),
         bounds("budget_scale", "budget_usd", [50000, 25000, 10000]),
         bounds("duration_strategy", "campaign_duration_days", [30, 14, 7])],
        f"CAST(start_date AS DATE) ASC NULLS FIRST, {down('expected_uplift_pct')}",
        ["promo_id", "target_market", "product_category", "expected_uplift_pct", "budget_usd"]),
}


def show(column: tuple[str, str, int | None]) -> str:
    name, source, places = column
    return f"{source if places is None else rounded(source, places)} AS {name}"


def ctes(s: Subject, window: tuple[str, str] = STUDY) -> str:
    """``wide``: each row of the window with its segment's measures and its ranks; ``labelled``: the output columns."""
    inside = f"{s.day} >= DATE '{window[0]}'" + ("" if s.open_end else f" AND {s.day} <= DATE '{window[1]}'")
    inside += "".join(f" AND {k} IS NOT NULL" for k in s.keys)
    columns = lambda d: "".join(f", {e} AS {n}" for n, e in d.items())
    return f"""WITH fact AS ({MAPPING[s.fact]}),
picked AS (SELECT *{columns(s.extra)} FROM fact WHERE {inside}),
measured AS (SELECT *{columns({n: over(*m, s.keys) for n, m in s.measures.items()})} FROM picked),
extended AS (SELECT *{columns(s.after)} FROM measured),
wide AS (SELECT *{columns({n: better(*r) for n, r in s.ranks.items()})} FROM extended),
labelled AS (SELECT {', '.join(map(show, s.shown))}, {', '.join(ladder(*x) for x in s.ladders)} FROM wide)"""


def top(s: Subject, limit: int = REPORT_LIMIT) -> str:
    names = [n for n, *_ in s.shown] + [x for c, _ in s.ladders for x in (c, f"{c}_code")]
    return f"SELECT * FROM labelled ORDER BY {s.order}, {', '.join(map(up, names))} LIMIT {limit}"


def report_sql(s: Subject, window: tuple[str, str] = STUDY) -> str:
    return f"{ctes(s, window)}\n{top(s)}"


def labels_sql(s: Subject) -> str:
    return f"{ctes(s)}\nSELECT * FROM labelled"


def ranks_sql(s: Subject) -> str:
    return f"{ctes(s)}\nSELECT {', '.join([*s.rank_view, *s.ranks])} FROM wide"


def segments_sql(s: Subject) -> str:
    return f"{ctes(s)}\nSELECT DISTINCT {', '.join(s.keys)}, {', '.join(map(show, s.segment))} FROM wide"


# ---------------------------------------------------------------- summary and insights

def kinds(c: str) -> str:
    """Distinct values, NULL being one."""
    return f"len(list_distinct(list(COALESCE({c}, '')))) "


def fixed(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(38,10))) AS DOUBLE)"


SUMMARY = {
    "competitor": {"unique_competitors": kinds("competitor"), "unique_markets": kinds("market"), "avg_price_gap": rounded(f"{fixed('price_gap_pct')} / COUNT(*)", 9),
                   "competitive_advantages": "COUNT(*) FILTER (price_gap_pct <= -15)"},
    "campaign": {"unique_campaigns": kinds("campaign_name"), "total_revenue": fixed("revenue_generated"), "total_cost": fixed("campaign_cost"),
                 "avg_roi": rounded(f"{fixed('roi_pct')} / COUNT(*)", 9)},
    "elasticity": {"price_points_analyzed": "COUNT(*)", "unique_markets": kinds("market"), "avg_elasticity": rounded(f"{fixed('elasticity_coefficient')} / COUNT(*)", 9),
                   "price_increase_opportunities": "COUNT(*) FILTER (recommendation = 'Increase Price')"},
    "promo": {"planned_campaigns": "COUNT(*)", "total_budget": fixed("budget_usd"), "avg_expected_uplift": rounded(f"{fixed('expected_uplift_pct')} / COUNT(*)", 9),
              "unique_markets": kinds("target_market")},
}


def basis(s: Subject, only_top: bool, window: tuple[str, str] = STUDY) -> str:
    return f"{ctes(s, window)},\nbasis AS ({top(s) if only_top else 'SELECT * FROM labelled'})"


def summary_sql(prefix: str, only_top: bool) -> str:
    s = SUBJECTS[prefix]
    fields = "".join(f", IF(COUNT(*) > 0, {e}, NULL) AS {n}" for n, e in SUMMARY[prefix].items())
    return f"{basis(s, only_top)}\nSELECT COUNT(*) AS total_records, IF(COUNT(*) > 0, {text(s.name)}, NULL) AS query_type{fields} FROM basis"


def labelled_as(column: str, *places: int) -> str:
    return f"COUNT(*) FILTER ({column} IN ({', '.join(text(LABELS[column][p]) for p in places)}))"


_BEST = f"campaign_performance_tier = {text(LABELS['campaign_performance_tier'][0])}"
# Per subject: number (what is reported), and what it fires: (kind, place, code), ...
FIRES = {
    "competitor": [
        (labelled_as("competitive_position", 1), [("insight", 1, "strong_price_advantage")]),
        (labelled_as("competitive_position", 3), [("alert", 1, "price_disadvantage"), ("recommendation", 1, "review_price_disadvantage")]),
        (labelled_as("value_proposition", 0), [("insight", 2, "premium_value_proposition")]),
        (labelled_as("promotional_environment", 0), [("alert", 2, "competitor_promo_pressure"), ("recommendation", 2, "respond_to_competitor_promos")]),
    ],
    "campaign": [
        (labelled_as("campaign_performance_tier", 3), [("alert", 1, "poor_campaigns"), ("recommendation", 1, "optimize_low_roi_types")]),
        (labelled_as("acquisition_effectiveness", 0), [("insight", 2, "efficient_acquisition")]),
        (labelled_as("retention_performance", 0), [("insight", 3, "excellent_retention")]),
    ],
    "elasticity": [
        (labelled_as("pricing_strategy", 0), [("insight", 1, "strong_increase_opportunity"), ("recommendation", 1, "pilot_price_increases")]),
        (labelled_as("price_optimization_status", 0), [("insight", 2, "under_priced"), ("recommendation", 2, "optimize_under_priced")]),
        (labelled_as("revenue_opportunity_level", 0), [("insight", 3, "high_revenue_impact"), ("recommendation", 3, "ab_test_high_impact")]),
        (labelled_as("sensitivity_classification", 2), [("insight", 4, "low_price_sensitivity"), ("recommendation", 4, "premium_pricing")]),
    ],
    "promo": [
        (labelled_as("campaign_priority_tier", 0), [("insight", 1, "high_impact_low_cost"), ("recommendation", 1, "execute_high_impact_low_cost")]),
        (labelled_as("competitive_intensity", 0), [("alert", 1, "competitive_battleground"), ("recommendation", 2, "differentiate_battlegrounds")]),
        (labelled_as("budget_scale", 0), [("insight", 4, "major_investments")]),
        (labelled_as("duration_strategy", 3), [("insight", 5, "flash_campaigns")]),
        (labelled_as("duration_strategy", 0), [("insight", 6, "extended_campaigns")]),
    ],
}
# Others: kind, place, code (SQL), number, whether it fires, detail.
SPECIAL = {
    "competitor": [("insight", 3, f"list_extract(['avg_gap_advantage', 'avg_gap_parity', 'avg_gap_disadvantage'], CAST(2 + (m > 10)::INT - (m < -10)::INT AS INT))",
                    rounded("m", 1), "c > 0", "NULL", f"{fixed('price_gap_pct')} / NULLIF(COUNT(price_gap_pct), 0) AS m, COUNT(price_gap_pct) AS c")],
    "campaign": [("insight", 1, "'top_campaign'", "m", "c > 0", "best", f"MAX(roi_pct) FILTER ({_BEST}) AS m, COUNT(*) FILTER ({_BEST}) AS c, "
                  f"first(campaign_name ORDER BY {down('roi_pct')}, {down('revenue_generated')}, campaign_date, campaign_name) FILTER ({_BEST}) AS best"),
                 ("insight", 4, "'overall_roi'", rounded("(m / c - 1) * 100", 1), "c > 0", "NULL", f"{fixed('revenue_generated')} AS m, {fixed('campaign_cost')} AS c")],
    "elasticity": [],
    "promo": [("insight", 2, "'high_impact_total'", "m", "TRUE", "NULL", f"{labelled_as('campaign_priority_tier', 0, 1)} AS m"),
              ("insight", 3, "'total_budget'", "m", "TRUE", "NULL", f"{fixed('budget_usd')} AS m")],
}


def insights_sql(prefix: str, only_top: bool, window: tuple[str, str] = STUDY) -> str:
    arms = []
    for number, fired in FIRES[prefix]:
        rows = ", ".join(f"('{k}', {p}, '{c}')" for k, p, c in fired)
        arms.append(f"SELECT kind, seq, code, CAST(m AS DOUBLE) AS metric, CAST(NULL AS VARCHAR) AS detail FROM (SELECT {number} AS m FROM basis) x, "
                    f"(VALUES {rows}) r(kind, seq, code) WHERE m > 0")
    for kind, place, code, number, fires, detail, stats in SPECIAL[prefix]:
        arms.append(f"SELECT '{kind}', {place}, {code}, CAST({number} AS DOUBLE), CAST({detail} AS VARCHAR) FROM (SELECT COUNT(*) AS n, {stats} FROM basis) x WHERE n > 0 AND {fires}")
    arms.append("SELECT kind, 1, code, 0.0, NULL FROM (VALUES ('insight', 'no_data'), ('recommendation', 'widen_criteria')) r(kind, code) WHERE NOT EXISTS (FROM basis)")
    union = "\nUNION ALL ".join(arms)
    return f"""{basis(SUBJECTS[prefix], only_top, window)},
fired AS ({union})
SELECT * FROM fired QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seq) <= IF(kind = 'insight', 10, 5)"""


# ---------------------------------------------------------------- intent routing

def hit(word: str, column: str = "text") -> str:
    return f"contains(lower(coalesce({column}, '')), {text(word)})"


def routing(mode: str = "first_match", column: str = "text") -> str:
    """Intent of a text: keywords hit per intent, as a list; the first non-zero or the first largest wins."""
    lists = [f"len(list_filter([{', '.join(hit(w, column) for w in dict.fromkeys(words))}], lambda x: x))" for words in KEYWORDS.values()]
    names = ", ".join(map(text, KEYWORDS))
    hits = f"[{', '.join(lists)}]"
    if mode == "first_match":
        place = f"list_position(list_transform({hits}, lambda n: n > 0), true)"
    else:
        place = f"IF(list_max({hits}) = 0, NULL, list_position({hits}, list_max({hits})))"
    return f"COALESCE(list_extract([{names}], {place}), {text(DEFAULT_INTENT)})"


def routing_sql(mode: str = "first_match") -> str:
    return f"SELECT conv_id, turn, {routing(mode)} AS intent FROM conversations WHERE role = 'user'"


def request_resolution() -> str:
    names = ", ".join(f"({text(a)}, {text(s)})" for a, s in ALIASES.items())
    return f"""
WITH turns AS (SELECT conv_id, turn, text, (conv_id + turn) % 12 AS k FROM conversations WHERE role = 'user'),
accepted(alias, subject) AS (VALUES {names}),
asked AS (
  SELECT conv_id, turn,
         CASE WHEN k < 8 THEN list_extract([{', '.join(map(text, ALIASES))}], CAST(k + 1 AS INT)) WHEN k = 8 THEN 'no_such_report' WHEN k = 9 THEN '' END AS query_type,
         CASE k WHEN 0 THEN -5 WHEN 1 THEN 0 WHEN 2 THEN 250 WHEN 3 THEN 9999 END AS wanted,
         CASE k WHEN 9 THEN 'Kampanya ROI' WHEN 10 THEN 'demand sensitivity?' WHEN 11 THEN 'SEASONAL calendar' ELSE text END AS question
  FROM turns)
SELECT conv_id, turn, query_type,
       CASE WHEN coalesce(query_type, '') = '' THEN {routing(column='question')} ELSE coalesce(subject, {text(DEFAULT_INTENT)}) END AS intent,
       CAST(least(greatest(coalesce(wanted, 100), 0), 500) AS INTEGER) AS row_limit
FROM asked LEFT JOIN accepted ON query_type = alias"""


ORACLE = {}
for _p, _s in SUBJECTS.items():
    ORACLE |= {f"{_p}_report": report_sql(_s), f"{_p}_labels": labels_sql(_s), f"{_p}_ranks": ranks_sql(_s), f"{_p}_segments": segments_sql(_s)}
    for _top, _suffix in ((False, ""), (True, "_report")):
        ORACLE |= {f"{_p}{_suffix}_summary": summary_sql(_p, _top), f"{_p}{_suffix}_insights": insights_sql(_p, _top)}
ORACLE |= {
    "competitor_report_written": f"{ctes(SUBJECTS['competitor'])}\n{top(SUBJECTS['competitor'], HIGHEST_LIMIT)}",
    "competitor_report_reference_window": report_sql(SUBJECTS["competitor"], REFERENCE),
    "competitor_insights_reference_window": insights_sql("competitor", True, REFERENCE),
    "intent_routing": routing_sql(),
    "intent_routing_score": routing_sql("score"),
    "request_mix": f"SELECT intent, COUNT(*) AS requests FROM ({routing_sql()}) r GROUP BY intent",
    "request_resolution": request_resolution(),
}


def oracle_sql() -> dict[str, str]:
    from oracle.tier_b import tier_b

    return {**ORACLE, **tier_b()}
