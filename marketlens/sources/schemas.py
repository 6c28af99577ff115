"""Declared schemas of the four report tables, and a column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, D, L, DT = T.StringType(), T.DoubleType(), T.LongType(), T.DateType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


COMPETITOR_TRACKING = _schema(
    ("tracking_date", DT), ("competitor", S), ("product_category", S), ("market", S),
    ("own_price_usd", D), ("competitor_price_usd", D), ("price_gap_pct", D), ("promotion_flag", S),
    ("quality_comparison", S), ("brand_positioning", S), ("market_share_impact", S),
)

CAMPAIGN_PERFORMANCE = _schema(
    ("campaign_date", DT), ("campaign_name", S), ("campaign_type", S), ("target_audience", S),
    ("discount_pct", D), ("original_price_usd", D), ("campaign_price_usd", D), ("units_sold", L),
    ("revenue_generated", D), ("campaign_cost", D), ("roi_pct", D), ("customer_acquisition", L),
    ("repeat_purchase_rate", D), ("market_segment", S),
)

PRICE_ELASTICITY = _schema(
    ("analysis_date", DT), ("product_category", S), ("market", S), ("price_point_usd", D),
    ("demand_quantity", L), ("elasticity_coefficient", D), ("customer_segment", S),
    ("sensitivity_level", S), ("optimal_price_usd", D), ("revenue_impact_pct", D),
    ("margin_impact_pct", D), ("recommendation", S),
)

PROMOTIONAL_CALENDAR = _schema(
    ("promo_id", S), ("start_date", S), ("end_date", S), ("campaign_name", S), ("target_market", S),
    ("product_category", S), ("discount_type", S), ("discount_value", D), ("min_purchase_usd", D),
    ("target_audience", S), ("expected_uplift_pct", D), ("budget_usd", D), ("channel", S),
    ("seasonality_factor", D), ("competitive_response", S),
)

SCHEMAS = {
    "competitor_tracking": COMPETITOR_TRACKING,
    "campaign_performance": CAMPAIGN_PERFORMANCE,
    "price_elasticity": PRICE_ELASTICITY,
    "promotional_calendar": PROMOTIONAL_CALENDAR,
}


def check_columns(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Fail early, naming the table, when a required column is missing or mistyped.

    Numeric columns of another numeric type are cast to the declared type.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in have]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}")
    out = []
    for f in schema.fields:
        got = have[f.name]
        if got == f.dataType:
            out.append(df[f.name])
        elif isinstance(got, T.NumericType) and isinstance(f.dataType, T.NumericType):
            out.append(df[f.name].cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.DateType) and isinstance(got, (T.TimestampType, T.TimestampNTZType)):
            out.append(df[f.name].cast(f.dataType).alias(f.name))
        else:
            raise TypeError(f"{table}.{f.name}: expected {f.dataType.simpleString()}, got {got.simpleString()}")
    # the month partition column of the stored layout stays, so that date windows prune partitions
    months = [c for c in ("tracking_month", "campaign_month", "analysis_month", "start_month") if c in have]
    return df.select(*out, *months)
