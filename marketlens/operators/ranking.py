"""SQL ``RANK()`` without funnelling rows through one task.

``RANK() OVER (ORDER BY k)`` without ``PARTITION BY`` plans as an
``Exchange SinglePartition``: every row meets in one task.  With a partition key
of low cardinality (five markets) the same happens five tasks at a time, and a
hot key holding a third of the rows lands in one task either way.

RANK only depends on the key: ``rank(k) = 1 + #rows with a strictly earlier
key`` inside the partition.  ``rank_columns`` / ``rank_over`` therefore work on
the *distinct* keys with their row counts (the group-by pre-aggregates map-side,
so a hot key collapses to one row before any shuffle):

1. ``keys``: distinct (partition, order) keys with weight = rows per key;
2. range-partition the keys table on (partition, order) and tag each row with
   its range bucket; the table is written under the checkpoint root so that the
   sampled borders are frozen (a recomputation cannot move a key to another
   bucket) and lineage is cut;
3. bucket totals -> exclusive offsets: one row per bucket (at most
   ``spark.sql.shuffle.partitions`` rows, or the ``buckets`` given), broadcast;
4. rows before a key = bucket offset + running weight inside the bucket
   (a window over one bucket: keys are spread evenly by the range sampling);
5. with a partition key, subtract the count before the partition's first key;
6. join the rank back on the keys, null-safe.  When the ranked keys table is
   under the broadcast threshold AQE broadcasts it; otherwise the sort-merge
   join has its skewed partitions split by AQE's skew-join handling.

Several ranks of one table build their key tables from that table alone and
concurrently, then join back one after another.

``rank_tables`` and ``join_ranks`` are the two halves, for callers that need the ranks of a
few rows only.  ``mode="window"`` is the plain ``F.rank()`` window, on explicit request only.
Weights let one input row stand for many (a segment rollup ranked as its detail
rows would be: every detail row of a segment shares the segment's value).
"""

from __future__ import annotations

import contextvars
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import materialize

OrderKey = tuple[str | Column, bool]  # (expression, ascending)

RANK_MODES = ("two_pass", "window")

def _expr(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sort(c: Column, ascending: bool) -> Column:
    # Spark's defaults, written out: NULLS FIRST ascending, NULLS LAST descending.
    return c.asc_nulls_first() if ascending else c.desc_nulls_last()


def _null_safe_on(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = None
    for lc, rc in pairs:
        term = left[lc].eqNullSafe(right[rc])
        cond = term if cond is None else cond & term
    return cond


def _window_rank(df: DataFrame, order: Sequence[OrderKey], partition_by: Sequence[str | Column],
                 name: str, weight: str | None) -> DataFrame:
    sort = [_sort(_expr(c), a) for c, a in order]
    w = Window.partitionBy(*[_expr(p) for p in partition_by]).orderBy(*sort)
    if weight is None:
        return df.withColumn(name, F.rank().over(w).cast("bigint"))
    peers = Window.partitionBy(*[_expr(p) for p in partition_by], *[_expr(c) for c, _ in order])
    through_peers = F.sum(weight).over(w)  # default frame: RANGE UNBOUNDED PRECEDING .. CURRENT ROW
    return df.withColumn(name, (through_peers - F.sum(weight).over(peers) + 1).cast("bigint"))


def rank_keys(keys: DataFrame, key_cols: Sequence[str], ascending: Sequence[bool],
              part_cols: Sequence[str], weight_col: str, name: str,
              buckets: int | None = None, total: str | None = None) -> DataFrame:
    """Rank a table of *distinct* keys with weights.

    Returns part_cols + key_cols + name (+ ``total``: the weight of the key's
    partition, i.e. the row count RANK's window sees, when ``total`` is given).
    """
    sort = [_sort(F.col(p), True) for p in part_cols] + [
        _sort(F.col(k), a) for k, a in zip(key_cols, ascending)]
    # Without an explicit count AQE may merge neighbouring ranges (still ordered);
    # either way the bucket count is at most spark.sql.shuffle.partitions.
    by_range = keys.repartitionByRange(buckets, *sort) if buckets else keys.repartitionByRange(*sort)
    ranged = materialize(by_range.withColumn("_bucket", F.spark_partition_id()), "rank-keys")
    totals = ranged.groupBy("_bucket").agg(F.sum(weight_col).alias("_bucket_w"))
    offsets = totals.select(
        "_bucket",
        F.coalesce(F.sum("_bucket_w").over(
            Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_bucket_w").over(Window.partitionBy()).alias("_all"))
    within = F.coalesce(F.sum(weight_col).over(
        Window.partitionBy("_bucket").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = (ranged.join(F.broadcast(offsets), "_bucket")  # one row per bucket: bounded by n
              .select(*part_cols, *key_cols, weight_col, "_all",
                      (F.col("_offset") + within).alias("_before")))
    extra = []
    if not part_cols:
        if total:
            extra = [F.col("_all").alias(total)]
        return before.select(*key_cols, (F.col("_before") + 1).cast("bigint").alias(name), *extra)
    starts = before.groupBy(*part_cols).agg(F.min("_before").alias("_start"), F.sum(weight_col).alias("_ptotal"))
    starts = starts.select(*[F.col(p).alias(f"{p}_s") for p in part_cols], "_start", "_ptotal")
    joined = before.join(starts, _null_safe_on(before, starts, [(p, f"{p}_s") for p in part_cols]))
    if total:
        extra = [F.col("_ptotal").alias(total)]
    return joined.select(*part_cols, *key_cols,
                         (F.col("_before") - F.col("_start") + 1).cast("bigint").alias(name), *extra)


@dataclass(frozen=True)
class RankSpec:
    """One RANK column: ORDER BY ``order`` within ``partition_by``, optionally weighted."""

    name: str
    order: Sequence[OrderKey]
    partition_by: Sequence[str | Column] = ()
    weight: str | None = None
    total: str | None = None  # also emit the rows of the rank's partition under this name


def rank_columns(df: DataFrame, specs: Sequence[RankSpec], mode: str = "two_pass",
                 buckets: int | None = None) -> DataFrame:
    """``df`` plus one bigint column per spec, each RANK() OVER its own window.

    Two-pass: every rank's key table is built from ``df`` itself (never from the
    output of another rank, which would drag a join of all rows into the next
    rank's job); the key tables are independent jobs, submitted concurrently;
    then each is joined back once, null-safe, on its own key columns.
    """
    if mode not in RANK_MODES:
        raise ValueError(f"mode must be one of {RANK_MODES}, got {mode!r}")
    if mode == "window":
        out = df
        # Global windows first: their single partition already satisfies any later
        # PARTITION BY, so the partitioned windows need no second exchange.
        for spec in sorted(specs, key=lambda s: len(s.partition_by)):
            if spec.total:
                raise ValueError("total is only produced by the two-pass rank")
            out = _window_rank(out, spec.order, spec.partition_by, spec.name, spec.weight)
        return out

    return join_ranks(df, rank_tables(df, specs, buckets))


@dataclass(frozen=True)
class RankTable:
    """Ranks by key: ``table`` has ``columns`` (partition and order keys, suffixed ``_r``) and the rank."""

    spec: RankSpec
    exprs: dict[str, Column]  # column name -> expression over the ranked frame
    table: DataFrame

    def renamed(self, prefix: str) -> RankTable:
        """The same table under other key names, to join several with one frame."""
        return RankTable(self.spec, {prefix + c: e for c, e in self.exprs.items()},
                         self.table.withColumnsRenamed({f"{c}_r": f"{prefix}{c}_r" for c in self.exprs}))


def rank_tables(df: DataFrame, specs: Sequence[RankSpec], buckets: int | None = None) -> list[RankTable]:
    """The key table of each rank of ``df``; independent jobs, submitted concurrently."""

    def key_table(i: int, spec: RankSpec) -> RankTable:
        part_cols = [f"_r{i}p{j}" for j in range(len(spec.partition_by))]
        key_cols = [f"_r{i}k{j}" for j in range(len(spec.order))]
        exprs = {**{pc: _expr(p) for pc, p in zip(part_cols, spec.partition_by)},
                 **{kc: _expr(c) for kc, (c, _) in zip(key_cols, spec.order)}}
        w = F.count(F.lit(1)) if spec.weight is None else F.sum(spec.weight)
        keys = df.withColumns(exprs).groupBy(*part_cols, *key_cols).agg(w.alias("_w"))
        ranked = rank_keys(keys, key_cols, [a for _, a in spec.order], part_cols, "_w", spec.name, buckets,
                           spec.total)
        return RankTable(spec, exprs, ranked.select(
            *[F.col(c).alias(f"{c}_r") for c in exprs], spec.name, *([spec.total] if spec.total else [])))

    if len(specs) < 2:
        return [key_table(i, s) for i, s in enumerate(specs)]
    with ThreadPoolExecutor(max_workers=len(specs)) as pool:
        futures = [pool.submit(contextvars.copy_context().run, key_table, i, s) for i, s in enumerate(specs)]
        return [f.result() for f in futures]


def join_ranks(df: DataFrame, tables: Sequence[RankTable], values: Sequence[dict[str, Column]] | None = None) -> DataFrame:
    """``df`` plus the rank of each row, by null-safe joins on the keys.

    ``values`` gives the key expressions over ``df`` where it is not the ranked frame itself.
    """
    exprs = [t.exprs for t in tables] if values is None else values
    out = df.withColumns({k: v for e in exprs for k, v in e.items()})
    for e, t in zip(exprs, tables):
        out = out.join(t.table, _null_safe_on(out, t.table, [(c, f"{c}_r") for c in e]))
        out = out.drop(*[f"{c}_r" for c in e])
    return out.drop(*[c for e in exprs for c in e])


def rank_over(df: DataFrame, order: Sequence[OrderKey], partition_by: Sequence[str | Column] = (),
              *, name: str, weight: str | None = None, mode: str = "two_pass",
              buckets: int | None = None, total: str | None = None) -> DataFrame:
    """``df`` plus column ``name`` = RANK() OVER (PARTITION BY .. ORDER BY ..) as bigint.

    ``weight`` names a column of row multiplicities (default: each row counts 1).
    """
    return rank_columns(df, [RankSpec(name, order, partition_by, weight, total)], mode, buckets)


def percent_rank_columns(df: DataFrame, specs: Sequence[RankSpec], mode: str = "two_pass",
                         buckets: int | None = None) -> DataFrame:
    """One PERCENT_RANK() column per spec: (rank - 1) / (rows in partition - 1), 0 for one row."""
    if mode == "window":
        out = df
        for spec in specs:
            sort = [_sort(_expr(c), a) for c, a in spec.order]
            w = Window.partitionBy(*[_expr(p) for p in spec.partition_by]).orderBy(*sort)
            out = out.withColumn(spec.name, F.percent_rank().over(w))
        return out
    tmp = [RankSpec(f"_{s.name}_rank", s.order, s.partition_by, s.weight, f"_{s.name}_total") for s in specs]
    out = rank_columns(df, tmp, mode, buckets)
    for spec, t in zip(specs, tmp):
        r, n = F.col(t.name), F.col(t.total)
        out = out.withColumn(spec.name, F.when(n > 1, (r - 1) / (n - 1)).otherwise(F.lit(0.0))).drop(t.name, t.total)
    return out


def percent_rank_over(df: DataFrame, order: Sequence[OrderKey], partition_by: Sequence[str | Column] = (),
                      *, name: str, mode: str = "two_pass", buckets: int | None = None) -> DataFrame:
    """``df`` plus ``name`` = PERCENT_RANK() over the given window."""
    return percent_rank_columns(df, [RankSpec(name, order, partition_by)], mode, buckets)
