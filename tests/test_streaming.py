"""TB-14: the stream equals the batch query on closed windows; late rows are dropped."""

import datetime as dt
import os
import tempfile

from marketlens.streaming.price_monitor import hourly_means, run_available

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _write(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                                     "value double, props string")
    df.coalesce(1).write.parquet(os.path.join(folder, name))


def _ev(i, minutes, kind, value):
    return (i, T0 + dt.timedelta(minutes=minutes), 1, kind, value, "{}")


def test_stream_two_batches_and_late_row(spark):
    root = tempfile.mkdtemp(prefix="ml-stream-")
    src, run = os.path.join(root, "src"), os.path.join(root, "run")
    os.makedirs(src)
    first = [_ev(1, 5, "click", 1.0), _ev(2, 50, "click", 3.0), _ev(3, 70, "view", 2.0), _ev(4, 200, "view", 4.0)]
    _write(spark, src, "b1", first)
    out1 = run_available(spark, src, run_dir=run)
    # watermark = 200 min - 2 h = 80 min: only the [0, 60) windows are closed
    assert sorted((r.event_type, r.events, r.mean_value) for r in out1.collect()) == [("click", 2, 2.0)]

    late = _ev(5, 10, "click", 100.0)          # event time 10 min < watermark 80 min: dropped
    second = [late, _ev(6, 400, "view", 6.0)]  # advances the watermark to 280 min
    _write(spark, src, "b2", second)
    out2 = run_available(spark, src, run_dir=run)
    got = sorted((r.window_start, r.event_type, r.events, r.mean_value) for r in out2.collect())

    batch = hourly_means(spark.createDataFrame(
        first + second[1:], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                            "value double, props string"))
    closed = [r for r in batch.collect() if r.window_end <= T0 + dt.timedelta(minutes=280)]
    want = sorted((r.window_start, r.event_type, r.events, r.mean_value) for r in closed)
    assert got == want
    assert all(v != 100.0 for *_, v in got)


def test_stream_reads_a_table_of_several_part_files(spark, tmp_path):
    from tests.conftest import SMALL
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    events.repartition(3).write.parquet(folder)
    key = lambda df: sorted(map(str, df.collect()))
    want = key(run_available(spark, f"{SMALL}/events.parquet"))
    assert want and key(run_available(spark, folder)) == want
