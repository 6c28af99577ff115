"""The distributed rank equals SQL RANK() (the window form) on data with ties and NULLs."""

import random

from pyspark.sql import functions as F

from marketlens.operators.ranking import rank_over


def _data(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.choice([None, *range(12)])
        a = rnd.choice([None, -1.5, 0.0, 2.25, 3.0, float(rnd.randint(-20, 20))])
        b = rnd.choice([None, 1, 2, 3])
        w = rnd.randint(1, 5)
        rows.append((i, k, a, b, w))
    return spark.createDataFrame(rows, "id int, k int, a double, b int, w int")


def _pairs(df, name):
    return sorted((r["id"], r[name]) for r in df.select("id", name).collect())


def test_global_rank_matches_window(spark):
    df = _data(spark)
    order = [("a", True)]
    got = rank_over(df, order, name="r", mode="two_pass", buckets=5)
    want = rank_over(df, order, name="r", mode="window")
    assert _pairs(got, "r") == _pairs(want, "r")


def test_compound_mixed_direction_rank(spark):
    df = _data(spark, seed=11)
    order = [("a", False), ("b", True)]
    got = rank_over(df, order, name="r", mode="two_pass", buckets=4)
    want = rank_over(df, order, name="r", mode="window")
    assert _pairs(got, "r") == _pairs(want, "r")


def test_partitioned_rank_matches_window(spark):
    df = _data(spark, seed=3)
    order = [(F.abs(F.col("a")), False)]
    got = rank_over(df, order, ["k"], name="r", mode="two_pass", buckets=6)
    want = rank_over(df, order, ["k"], name="r", mode="window")
    assert _pairs(got, "r") == _pairs(want, "r")


def test_weighted_rank_equals_expanded_rows(spark):
    df = _data(spark, n=120, seed=5)
    got = rank_over(df, [("a", True)], name="r", weight="w", mode="two_pass", buckets=3)
    win = rank_over(df, [("a", True)], name="r", weight="w", mode="window")
    assert _pairs(got, "r") == _pairs(win, "r")
    # expand each row w times: the rank of any copy equals the weighted rank
    expanded = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w"))))
    plain = rank_over(expanded, [("a", True)], name="r", mode="window").where("copy = 1")
    assert _pairs(got, "r") == _pairs(plain, "r")


def test_two_pass_plan_has_no_single_partition_over_rows(spark):
    df = _data(spark)
    out = rank_over(df, [("a", True)], name="r", mode="two_pass")
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the only single-partition step is the per-bucket offsets table (one row per bucket)
    window_plan = rank_over(df, [("a", True)], name="r", mode="window")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SinglePartition" in window_plan
    assert plan.count("SinglePartition") <= 1


def test_percent_rank_matches_window(spark):
    from marketlens.operators.ranking import percent_rank_over
    df = _data(spark, seed=13)
    for parts in ([], ["k"]):
        got = percent_rank_over(df, [("a", True)], parts, name="p", mode="two_pass", buckets=4)
        want = percent_rank_over(df, [("a", True)], parts, name="p", mode="window")
        assert _pairs(got, "p") == _pairs(want, "p")


def test_hot_key_third_of_rows(spark):
    """One key holds a third of the rows: it collapses to one row of the keys table,
    so no bucket holds it more than once, and the ranks stay exact."""
    from marketlens.operators.ranking import rank_over
    n = 3000
    rows = [(i, 7.0 if i % 3 == 0 else float(i % 997), "hot" if i % 3 == 0 else f"m{i % 5}") for i in range(n)]
    df = spark.createDataFrame(rows, "id int, v double, m string")
    for parts in ([], ["m"]):
        got = rank_over(df, [("v", False)], parts, name="r", mode="two_pass", buckets=8)
        want = rank_over(df, [("v", False)], parts, name="r", mode="window")
        assert _pairs(got, "r") == _pairs(want, "r")


def _chosen_ranks(spark, df, specs, n):
    from marketlens.operators.interval_rank import Intervals, as_text, counts, partition_start, sort_key, with_ranks
    chosen = spark.createDataFrame(df.orderBy("id").limit(n).toArrow(), df.schema)
    intervals = []
    for s in specs:
        key = sort_key(s)
        schema = chosen.select(key.alias("k")).schema["k"].dataType
        texts = [as_text(key).alias("a"), as_text(partition_start(key, schema)).alias("b")]
        intervals.append(Intervals(s, schema, [t for r in chosen.select(*texts).collect() for t in r]))
    return with_ranks(chosen, intervals, counts(df, intervals))


def test_interval_ranks_match_windows(spark):
    from marketlens.operators.ranking import RankSpec, rank_columns
    df = _data(spark, n=900, seed=13).withColumn("a", F.when(F.col("id") % 17 == 0, F.lit(float("nan"))).when(F.col("id") % 23 == 0, -0.0).otherwise(F.col("a")))
    df = df.withColumn("name", F.concat(F.lit('"q\\'), F.col("k").cast("string"))).withColumn("day", F.date_add(F.lit("1998-01-01").cast("date"), F.col("id") % 9))
    specs = [RankSpec("r0", [("a", True)]), RankSpec("r1", [("a", False), ("b", True)]), RankSpec("r2", [(F.abs(F.col("a")), False)], ["k"]),
             RankSpec("r3", [("a", True)], ["name", "k"]), RankSpec("r4", [("day", True), ("name", True)]), RankSpec("r5", [("a", False)], ["k"], "w")]
    want = {r["id"]: r for r in rank_columns(df, specs, "window").collect()}
    for n in (1, 2, 60, 500):
        got = _chosen_ranks(spark, df, specs, n).collect()
        assert len(got) == n
        for r in got:
            assert all(r[s.name] == want[r["id"]][s.name] for s in specs), (r, want[r["id"]])


def test_interval_ranks_of_rows_that_are_absent(spark):
    from marketlens.operators.ranking import RankSpec
    assert _chosen_ranks(spark, _data(spark).limit(0), [RankSpec("r0", [("a", True)], ["k"])], 5).count() == 0
