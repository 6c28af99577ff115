"""Box index and exact selection against brute force."""

import math
import random
import re

from pyspark.sql import functions as F

from marketlens import session
from marketlens.operators import box_index
from marketlens.operators.box_index import best_boxes
from marketlens.operators.selection import exact_quantiles

DIMS = [("x", "x_lo", "x_hi"), ("y", "y_lo", "y_hi")]
BOX = "priority int, id string, x_lo double, x_hi double, y_lo int, y_hi int"


def _best(x, y, boxes):
    def inside(v, lo, hi):
        if v is None or v != v:
            return lo is None and hi is None
        return (lo is None or v >= lo) and (hi is None or v < hi)
    won = [(p, i) for p, i, a, b, c, d in boxes if inside(x, a, b) and inside(y, c, d)]
    return min(won)[1] if won else None


def _boxes(rnd, n):
    end = lambda top: rnd.choice([None, float(rnd.randint(-5, top)), rnd.uniform(0, top), 1e12])
    whole = lambda: rnd.choice([None, rnd.randint(0, 9)])
    return [(rnd.randint(0, 6), f"b{i}", end(30), end(30), whole(), whole()) for i in range(n)]


def test_best_boxes_match_brute_force(spark):
    for seed, n in ((1, 1), (2, 7), (3, 120)):
        rnd = random.Random(seed)
        boxes = _boxes(rnd, n)
        points = [(rnd.choice([None, float("nan"), float(rnd.randint(-6, 31)), 1e12, -1e300]), rnd.choice([None, *range(-1, 11)])) for _ in range(150)]
        df = spark.createDataFrame(points, "x double, y int")
        got = best_boxes(df, spark.createDataFrame(boxes, BOX), DIMS, ["priority", "id"], ["id"]).collect()
        found = {(r["x"], r["y"]): r["id"] for r in got}
        assert len(found) == len(got)
        for x, y in points:
            assert found.get((None if x is not None and x != x else x, y)) == _best(x, y, boxes), (x, y)


def test_best_boxes_without_boxes_or_points(spark):
    df, boxes = spark.createDataFrame([(1.0, 2)], "x double, y int"), spark.createDataFrame([(1, "b", 0.0, 9.0, 0, 9)], BOX)
    assert best_boxes(df, boxes.limit(0), DIMS, ["priority"], ["id"]).count() == 0
    assert best_boxes(df.limit(0), boxes, DIMS, ["priority"], ["id"]).count() == 0


def test_ten_thousand_boxes_stay_in_few_products(spark):
    """Half of the boxes reach to one far-off value; a point still looks up one row a pair of levels."""
    rows = [(i, f"b{i:05d}", i * 0.5, 1e12 if i % 2 else i * 0.5 + 3, 0, 50) for i in range(10_000)]
    df = spark.range(2000).select((F.col("id") * 2.6).alias("x"), (F.col("id") % 50).cast("int").alias("y"))
    got = {r["x"]: r["id"] for r in best_boxes(df, spark.createDataFrame(rows, BOX), DIMS, ["priority"], ["id"]).collect()}
    for k in range(0, 2000, 111):
        x = k * 2.6
        want = min((p, i) for p, i, lo, hi, _, _ in rows if lo <= x < hi) if x < 1e12 else None
        assert got[x] == want[1]


def test_boxes_are_dealt_out_by_their_products(spark, monkeypatch):
    """The node products of boxes from one file are made in many tasks, and no rows are sorted to find the best."""
    plans, written = {}, box_index.materialize
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)

    def seen(df, label, **options):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label, **options)

    monkeypatch.setattr(box_index, "materialize", seen)
    boxes = _boxes(random.Random(4), 60)
    copies = spark.createDataFrame(boxes * 3, BOX).coalesce(1)
    points = [(i / 3, i % 9) for i in range(60)]
    got = box_index.best_boxes(spark.createDataFrame(points, "x double, y int"), copies, DIMS, ["priority", "id"], ["id"]).collect()
    assert {(r["x"], r["y"]): r["id"] for r in got} == {(x, y): best for x, y in points if (best := _best(x, y, boxes))}
    assert "SortAggregate" not in plans["box-products"]
    above, _, below = plans["box-products"].rpartition("Generate")
    tasks = re.search(r"hashpartitioning\(turn\S*, (\d+)\), REPARTITION_BY_NUM", below)
    assert above and int(tasks[1]) > 1


def _nearest_rank(values, p):
    values = sorted(values, key=lambda v: (v != v, v))
    return values[max(1, math.ceil(len(values) * p)) - 1]


def test_exact_quantiles_match_sorting(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([rnd.gauss(0, 1), rnd.uniform(-1e12, 1e12), 7.5, 7.5, 0.0, None])) for _ in range(6000)]
    rows += [("one", 3.25), ("none", None), ("same", 1.0), ("same", 1.0), ("nan", float("nan")), ("nan", 2.0)]
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), ["k"], "v", shares).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in shares.items():
            want = _nearest_rank(values, p)
            assert got[k][name] == want or (want != want and got[k][name] != got[k][name]), (k, name)
