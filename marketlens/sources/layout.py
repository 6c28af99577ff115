"""Storage layout for the report tables: partitioned by month of their date.

At cluster scale the report tables are best derived once (one pass of the
joins in ``derived``) and stored partitioned by month; every report's date
window then prunes whole partitions instead of reading every file's footer.
``detail()`` of each subject adds the month predicate whenever the month column
is present, so the same report code reads both layouts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources.derived import FACT_BUILDERS

# report table -> (date column, month partition column)
MONTH_PARTITION = {
    "competitor_tracking": ("tracking_date", "tracking_month"),
    "campaign_performance": ("campaign_date", "campaign_month"),
    "price_elasticity": ("analysis_date", "analysis_month"),
    "promotional_calendar": ("start_date", "start_month"),
}


def month_of(table: str) -> F.Column:
    date_col, _ = MONTH_PARTITION[table]
    day = F.to_date(F.col(date_col), "yyyy-MM-dd") if table == "promotional_calendar" else F.col(date_col)
    return F.trunc(day, "month")


def write_facts(tables: Mapping[str, DataFrame], root: str,
                names: Iterable[str] = tuple(FACT_BUILDERS), mode: str = "overwrite") -> dict[str, str]:
    """Derive each report table and write it under ``root/<table>`` partitioned by month.

    The REBALANCE hint lets AQE cluster rows by month before the write (few
    files per month) while splitting a month that holds a large share of the
    rows over several tasks instead of one.
    """
    paths = {}
    for name in names:
        _, month_col = MONTH_PARTITION[name]
        df = FACT_BUILDERS[name](tables).withColumn(month_col, month_of(name))
        path = f"{root.rstrip('/')}/{name}"
        df.hint("rebalance", month_col).write.mode(mode).partitionBy(month_col).parquet(path)
        paths[name] = path
    return paths


def read_facts(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def month_predicate(facts: DataFrame, table: str, start, end=None) -> F.Column | None:
    """Predicate on the month partition column matching a date window, if present."""
    _, month_col = MONTH_PARTITION[table]
    if month_col not in facts.columns:
        return None
    lo = F.trunc(F.lit(start), "month")
    cond = F.col(month_col) >= lo
    if end is not None:
        cond = cond & (F.col(month_col) <= F.trunc(F.lit(end), "month"))
    return cond


# base table -> bucketing key; tables sharing a key and a bucket count join without a shuffle
BUCKET_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def write_bucketed(tables: Mapping[str, DataFrame], database: str, buckets: int,
                   names: Iterable[str] = tuple(BUCKET_KEYS), mode: str = "overwrite") -> dict[str, str]:
    """Save base tables as catalog tables bucketed (and sorted) by their order key.

    With lineitem and orders in the same number of buckets, the per-order
    aggregation of campaign metrics and the lineitem-orders joins read co-located
    buckets: no exchange on either side.  Read them back with
    ``Tables.catalog(spark, database)``; tables not written here (part, customer,
    ...) are read from ``tables`` unchanged.
    """
    written = {}
    for name in names:
        key = BUCKET_KEYS[name]
        full = f"{database}.{name}"
        tables[name].write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(full)
        written[name] = full
    return written


class Layered(Mapping):
    """Base tables where some names come from a catalog database (e.g. bucketed copies)."""

    def __init__(self, spark: SparkSession, database: str, names: Iterable[str], fallback: Mapping[str, DataFrame]):
        self._db, self._names, self._fallback, self._spark = database, set(names), fallback, spark

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._names:
            return self._spark.table(f"{self._db}.{name}")
        return self._fallback[name]

    def __iter__(self):
        return iter(self._fallback)

    def __len__(self):
        return len(self._fallback)
