"""Exact order statistics of many values a group, without sorting a group in one task.

A quantile of a group is one of its values.  Each round takes a bounded sketch of approximate
quantiles of the values still in question as splitters, counts the values below, at and between the
splitters exactly (a binary search in the row, one partial aggregation), and keeps the
one interval that holds the wanted rank; a rank that falls on a splitter is settled at once, so
frequent values cost nothing.  After ``ROUNDS`` rounds an interval holds about n / SPLITTERS^ROUNDS
distinct values; a last count of those values settles the rest.  The number of scans
is fixed, and correctness does not rest on the sketch's error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import materialize

SPLITTERS, ACCURACY, ROUNDS = 511, 5000, 2


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """``keys`` and one column a quantile: the smallest value that a share of at least q of the group's values does not exceed.

    NULL values are left out (a group of only NULLs does not appear); NULL keys are a group; NaN is the largest value.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(p).alias("p")) for q, p in quantiles.items()])
    state = counted.select(*names, "n", F.explode(wanted).alias("w")).select(
        *names, F.col("w.q").alias("q"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("w.p"))).cast("bigint").alias("rank"),
        *[F.lit(None).cast("double").alias(c) for c in ("low", "high", "found")])
    state = materialize(state, "quantile-state")
    shares = F.array(*[F.lit((i + 1) / (SPLITTERS + 1)) for i in range(SPLITTERS)])

    def inside(open_: DataFrame) -> DataFrame:
        right = open_.select(*[F.col(n).alias(f"{n}_s") for n in names], "q", "low", "high", *[c for c in ("splits",) if c in open_.columns])
        on = F.lit(True)
        for n in names:
            on = on & F.col(n).eqNullSafe(F.col(f"{n}_s"))
        above = F.col("low").isNull() | (F.col("x") > F.col("low"))
        below = F.col("high").isNull() | (F.col("x") < F.col("high"))
        return rows.join(right, on & above & below).drop(*[f"{n}_s" for n in names], "low", "high")

    for _ in range(ROUNDS):
        open_ = state.filter(F.col("found").isNull())
        splits = inside(open_).groupBy(*names, "q").agg(F.sort_array(F.array_distinct(F.percentile_approx("x", shares, ACCURACY))).alias("splits"))
        open_ = materialize(_join(open_, splits, [*names, "q"]), "quantile-splits")
        placed = inside(open_).withColumn("at", F.lit(0))
        step = 1 << SPLITTERS.bit_length()
        while step := step >> 1:  # at: how many splitters are not above the value
            hit = F.coalesce(F.get("splits", F.col("at") + (step - 1)) <= F.col("x"), F.lit(False))
            placed = placed.withColumn("at", F.col("at") + F.when(hit, step).otherwise(0))
        on_it = (F.col("at") > 0) & (F.get("splits", F.col("at") - 1) == F.col("x"))
        # Slot 2i is the values equal to splitter i, slot 2i + 1 those between it and the next one.
        counts = placed.groupBy(*names, "q", (2 * F.col("at") + F.when(on_it, 0).otherwise(1)).alias("slot")).agg(F.count(F.lit(1)).alias("m"))
        w = Window.partitionBy(*names, "q").orderBy("slot")
        counts = _join(counts.withColumn("upto", F.sum("m").over(w)), open_, [*names, "q"]).filter(
            (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        i = F.floor(F.col("slot") / 2).cast("int")
        settled = F.when(F.col("slot") % 2 == 0, F.get("splits", i - 1))
        low = F.coalesce(F.when(i > 0, F.get("splits", i - 1)), F.col("low"))
        high = F.coalesce(F.get("splits", i), F.col("high"))
        narrowed = counts.select(*names, "q", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"), low.alias("low"), high.alias("high"), settled.alias("found"))
        state = materialize(state.filter(F.col("found").isNotNull()).unionByName(narrowed), "quantile-state")
    left = inside(state.filter(F.col("found").isNull())).groupBy(*names, "q", "x").agg(F.count(F.lit(1)).alias("m"))
    left = left.withColumn("upto", F.sum("m").over(Window.partitionBy(*names, "q").orderBy("x")))
    last = _join(left, state.filter(F.col("found").isNull()), [*names, "q"]).filter("upto >= rank").groupBy(*names, "q").agg(F.min("x").alias("found"))
    done = state.filter(F.col("found").isNotNull()).select(*names, "q", "found").unionByName(last)
    return done.groupBy(*names).agg(*[F.max(F.when(F.col("q") == q, F.col("found"))).alias(q) for q in quantiles]).withColumnsRenamed(dict(zip(names, keys)))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Null-safe inner join that keeps the key columns once."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, cond).drop(*[f"_{c}" for c in on])
