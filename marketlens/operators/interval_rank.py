"""SQL ``RANK()`` of a few chosen rows, by counting the rows between their keys.

A report shows at most a few hundred rows, but each with its rank among all rows.  The rank
of a key is one plus the number of rows with an earlier key, so the chosen keys, sorted,
cut the key space into intervals, and one aggregation counts the rows of each interval: every row
finds its interval by binary search in the sorted array (a literal in the plan, one step a
column, no join), the partial aggregation leaves one row an interval and task, and
the running sums are the ranks.  Nothing is sorted, written or shuffled but those counts.

A sort key is a struct that orders ascending as the rank does (``sort_key``), partition
columns first.  A partition's first row is found with a sentinel that stands before all its rows.
The number of keys is bounded by the caller's row limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.ranking import RankSpec


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sort_key(spec: RankSpec) -> Column:
    """A struct whose ascending order is the rank's: NULL first ascending and last descending, NaN above all numbers.

    A descending number is negated; two flags in front of it put NULL last and NaN first.
    """
    fields = [_col(p).alias(f"p{i}") for i, p in enumerate(spec.partition_by)] + [F.lit(1).alias("tag")]
    for i, (c, ascending) in enumerate(spec.order):
        c = _col(c)
        if ascending:
            fields.append(c.alias(f"o{i}"))
        else:
            fields += [c.isNull().alias(f"null{i}"), (~F.isnan(c.cast("double"))).alias(f"number{i}"), (-c).alias(f"o{i}")]
    return F.struct(*fields)


def partition_start(key: Column, schema: T.StructType) -> Column:
    """The sentinel before all rows of the key's partition."""
    parts = [key[f.name].alias(f.name) for f in schema if f.name.startswith("p")]
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if not f.name.startswith("p") and f.name != "tag"]
    return F.struct(*parts, F.lit(0).alias("tag"), *rest)


def as_text(key: Column) -> Column:
    return F.to_json(key, {"ignoreNullFields": "false"})


class Intervals:
    """The intervals of one rank: its chosen keys as JSON texts, and the key's type."""

    def __init__(self, spec: RankSpec, schema: T.StructType, keys: Sequence[str]):
        self.spec, self.schema = spec, schema
        self.size = len(set(keys))
        text = "[" + ",".join(sorted(set(keys))) + "]"
        self.keys = F.sort_array(F.from_json(F.lit(text), T.ArrayType(schema)))  # folded into a literal


def place(df: DataFrame, keys: dict[str, tuple[Intervals, Column]]) -> DataFrame:
    """Adds an int column for each entry: how many of the interval's keys are not after the row's key."""
    df = df.withColumns({f"_k{name}": key for name, (_, key) in keys.items()})
    df = df.withColumns({name: F.lit(0) for name in keys})
    step = 1 << max(intervals.size for intervals, _ in keys.values()).bit_length()
    while step := step >> 1:
        further = {}
        for name, (intervals, _) in keys.items():
            if step <= intervals.size:
                not_after = F.coalesce(F.get(intervals.keys, F.col(name) + (step - 1)) <= F.col(f"_k{name}"), F.lit(False))
                further[name] = F.col(name) + F.when(not_after, step).otherwise(0)
        df = df.withColumns(further)
    return df.drop(*[f"_k{name}" for name in keys])


def counts(df: DataFrame, intervals: Sequence[Intervals]) -> list[list[int]]:
    """Rows (or weight) of ``df`` before each chosen key of each rank: one pass over ``df``.

    At most one row an interval reaches the driver.
    """
    placed = place(df, {f"_i{i}": (x, sort_key(x.spec)) for i, x in enumerate(intervals)})
    entries = [F.struct(F.lit(i).alias("rank"), F.col(f"_i{i}").alias("interval"), (F.lit(1) if x.spec.weight is None else F.col(x.spec.weight)).cast("bigint").alias("n"))
               for i, x in enumerate(intervals)]
    rows = placed.select(F.explode(F.array(*entries)).alias("e")).groupBy("e.rank", "e.interval").agg(F.sum("e.n").alias("n")).collect()
    out = [[0] * (x.size + 1) for x in intervals]
    for r in rows:
        out[r["rank"]][r["interval"]] = r["n"]
    return [[sum(c[: i + 1]) for i in range(len(c))] for c in out]


def with_ranks(chosen: DataFrame, intervals: Sequence[Intervals], before: Sequence[Sequence[int]]) -> DataFrame:
    """The chosen rows with their ranks (bigint), from the counts before each key."""
    names = {}
    for i, x in enumerate(intervals):
        names[f"_i{i}"] = (x, sort_key(x.spec))
        if x.spec.partition_by:
            names[f"_s{i}"] = (x, partition_start(sort_key(x.spec), x.schema))
    out = place(chosen, names)
    ranks = {}
    for i, (x, b) in enumerate(zip(intervals, before)):
        table = F.split(F.lit(",".join(map(str, b))), ",").cast("array<bigint>")
        rank = F.get(table, F.col(f"_i{i}") - 1) + 1
        ranks[x.spec.name] = rank - F.get(table, F.col(f"_s{i}") - 1) if x.spec.partition_by else rank
    return out.withColumns(ranks).drop(*names)
