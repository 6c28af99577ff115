"""Segment rollup joined back to its own detail rows.

``GROUP BY keys`` with map-side partial aggregation, then an inner equi-join of
the detail to the rollup on the same keys.  The rollup has one row per segment,
so AQE broadcasts it at runtime when it is under the broadcast threshold (a
size checked by Spark on the materialised rollup); past that the join stays a
sort-merge join whose hot partitions AQE splits.  No rows are dropped except
those the reference drops: a NULL key never equals the rollup's NULL group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(detail: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return detail.groupBy(*keys).agg(*aggs)


def join_back(detail: DataFrame, segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """detail JOIN segments USING (keys): inner, plain equality (NULL keys drop)."""
    return detail.join(segments, list(keys), "inner")


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows an inner join-back keeps; used when ranks must see the joined set."""
    cond = None
    for k in keys:
        term = F.col(k).isNotNull()
        cond = term if cond is None else cond & term
    return df.where(cond) if cond is not None else df
