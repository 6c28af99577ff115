"""Best matching box of each point: a range join over several dimensions without a residual range test.

A box holds an interval [low, high) of every dimension (NULL: open on that side) and a priority; a
point belongs to the box with the smallest (priority, id) among those that contain it.

In each dimension the boxes' own end points cut the axis into segments, numbered in rank
space, so that one far-off value shifts nothing.  An interval of segments is the union of at most
two dyadic nodes a level, a point lies in one node a level.  A box goes to the products of its
nodes, where one aggregation keeps the best box of every product: inside a product all
boxes match, so no more are needed, however many rules share a range.  A point looks up one
product for each combination of levels that occurs (at most the product of the logarithms of
the end points, read as a list of level pairs), by an equi-join, and keeps the best.

Distinct boxes are numbered in the order of their priority first, so that the products carry one number a box
and their aggregation is a hash aggregation of that number; the winners' columns join at the
end.  The boxes are dealt out by the products they make, so a task's memory does not grow with them.

Equal points are matched once.  The rank of a value among the end points comes from the
distributed rank of the distinct values, so neither side is collected or broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.operators.ranking import rank_keys
from marketlens.session import dealt, materialize, tasks_for


def _places(values: DataFrame, ends: DataFrame) -> DataFrame:
    """``value`` -> ``at``: how many of the distinct ``ends`` are not above it, for all values of both."""
    both = ends.select("value", F.lit(1).alias("w")).unionByName(values.select("value", F.lit(0).alias("w")))
    keys = both.groupBy("value").agg(F.max("w").cast("bigint").alias("w"))
    ranked = rank_keys(keys, ["value"], [True], [], "w", "r").join(keys.withColumnRenamed("value", "v"), F.col("value") == F.col("v"))
    return ranked.select("value", (F.col("r") - 1 + F.col("w")).alias("at"))


def _nodes(first: Column, end: Column, levels: int) -> Column:
    """The dyadic nodes (level, number) whose union is the segments [first, end).

    At each level the interval sheds its odd first node and its odd end and goes on with the halves.
    """
    out = []
    for k in range(levels + 1):
        a, b = F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(end, k)
        out.append(F.when((a < b) & (a % 2 == 1), F.struct(F.lit(k).alias("level"), a.alias("node"))))
        out.append(F.when((a < b) & (b % 2 == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("node"))))
    return F.array_compact(F.array(*out))


def best_boxes(points: DataFrame, boxes: DataFrame, dims: Sequence[tuple[str, str, str]], priority: Sequence[str], result: Sequence[str]) -> DataFrame:
    """The distinct dimension values of ``points`` that lie in a box, with the ``result`` columns of the best one.

    ``dims`` names, for each dimension, the point's column and the box's low and high columns (numbers).
    ``priority`` columns decide, smallest first (the last of them should tell boxes apart).  A NULL or NaN
    point value matches only boxes that are open on both sides there.  Empty intervals match nothing.
    """
    names = [f"d{i}" for i in range(len(dims))]
    point_rows = points.select(*[F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double")).alias(n) for n, (p, _, _) in zip(names, dims)]).distinct()
    point_rows, points_n = materialize(point_rows, "box-points", count=True)
    ends = {n: (F.col(lo).cast("double"), F.col(hi).cast("double")) for n, (_, lo, hi) in zip(names, dims)}
    turns, wons = [f"t{i}" for i in range(len(priority))], [f"w{i}" for i in range(len(result))]
    bounds = {f"{n}{side}": c for n, pair in ends.items() for side, c in zip(("lo", "hi"), pair)}
    order = [*turns, *wons, *bounds]
    distinct = boxes.select(*[F.col(c).alias(t) for c, t in zip([*priority, *result], turns + wons)], *[c.alias(n) for n, c in bounds.items()]).distinct()
    distinct, boxes_n = materialize(distinct.withColumn("w", F.lit(1).cast("bigint")), "boxes", count=True)
    numbered = rank_keys(distinct, order, [True] * len(order), [], "w", "turn", tasks_for(boxes_n))
    numbered = materialize(numbered, "boxes-numbered")
    box_rows = numbered.select("turn", *bounds)
    levels, placed = {}, point_rows
    for n in names:
        both = box_rows.select(F.explode(F.array(f"{n}lo", f"{n}hi")).alias("value")).filter("value is not null").distinct()
        table = materialize(_places(point_rows.select(F.col(n).alias("value")).filter("value is not null").distinct(), both), "box-places")
        top = both.count()  # segments are numbered 0 to top; those of an open box reach from 0 to top
        levels[n] = (top + 1).bit_length()
        look = lambda df, c, to: df.join(table.select(F.col("value").alias("_v"), F.col("at").alias(to)), F.col(c) == F.col("_v"), "left").drop("_v")  # noqa: B023, E731
        placed = look(placed, n, f"{n}at")
        box_rows = look(look(box_rows, f"{n}lo", "_lo"), f"{n}hi", "_hi")
        anything = F.col(f"{n}lo").isNull() & F.col(f"{n}hi").isNull()
        first = F.when(F.col(f"{n}lo").isNull(), F.lit(0)).otherwise(F.col("_lo"))
        end = F.when(F.col(f"{n}hi").isNull(), F.lit(top + 1)).otherwise(F.col("_hi"))
        box_rows = box_rows.withColumns({f"{n}first": F.when(~anything, first).cast("bigint"), f"{n}end": end.cast("bigint")}).drop("_lo", "_hi", f"{n}lo", f"{n}hi")
    box_rows = materialize(box_rows, "box-segments")
    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("node")))  # the node that NULL lies in, too
    nodes = {n: F.when(F.col(f"{n}first").isNull(), whole).otherwise(_nodes(F.col(f"{n}first"), F.col(f"{n}end"), levels[n])) for n in names}
    made = reduce(Column.__mul__, [F.size(c).cast("bigint") for c in nodes.values()])
    product = dealt(box_rows, box_rows.agg(F.sum(made)).first()[0] or 0, "turn")
    for n, c in nodes.items():
        product = product.withColumn(f"{n}node", F.explode(c)).drop(f"{n}first", f"{n}end")
    node = [f"{n}{part}" for n in names for part in ("level", "number")]
    product = product.select("turn", *[F.col(f"{n}node")[part].alias(f"{n}{name}") for n in names for part, name in (("level", "level"), ("node", "number"))])
    product = materialize(product.groupBy(*node).agg(F.min("turn").alias("turn")), "box-products")
    # Which combinations of levels occur: at most one a level and dimension.
    shapes = [tuple(r) for r in product.select(*[f"{n}level" for n in names]).distinct().collect()]
    values = [F.col(n).alias(p) for n, (p, _, _) in zip(names, dims)]
    if not shapes:
        return point_rows.limit(0).select(*values, *[F.lit(None).cast(numbered.schema[w].dataType).alias(c) for c, w in zip(result, wons)])

    def lookup(shape: tuple) -> Column:
        number = {n: F.lit(0).cast("bigint") if k < 0 else F.shiftright(F.col(f"{n}at"), k) for n, k in zip(names, shape)}
        return F.struct(*[c for n, k in zip(names, shape) for c in (F.lit(k).alias(f"{n}level"), number[n].alias(f"{n}number"))])

    asked = dealt(placed, points_n * len(shapes), *names).withColumn("look", F.explode(F.array(*[lookup(s) for s in shapes]))).select(*names, "look.*")
    found = materialize(asked.join(product, node).groupBy(*names).agg(F.min("turn").alias("turn")), "box-found")
    # One box may win many points: the winners alone, joined, are few then.
    winners = numbered.select("turn", *wons).join(found.select("turn").distinct(), "turn", "left_semi")
    return found.join(winners, "turn").select(*values, *[F.col(w).alias(c) for c, w in zip(result, wons)])
