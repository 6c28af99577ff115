"""Deterministic top-n.

``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps
its own n best rows and only those meet at the end, so the cost is a scan, not
a global sort.  The reference's sort keys are not unique, so every output column
is appended as a tie-break (ascending, Spark's NULL order) and the chosen rows
do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

_UNORDERABLE = (T.MapType,)


def full_order(df: DataFrame, order: Sequence[Column]) -> list[Column]:
    tie = [df[f.name].asc_nulls_first() for f in df.schema.fields
           if not isinstance(f.dataType, _UNORDERABLE)]
    return [*order, *tie]


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*full_order(df, order)).limit(n)
