"""TB-7 seasonal adjustment against a plain Python fit, and its edge cases."""

import datetime as dt
import statistics

import pytest

from marketlens.plans import seasonal

ROWS = "tracking_date date, market string, competitor_price_usd double"


def day(t, d=1):
    return dt.date(1970 + t // 12, t % 12 + 1, d)


def line(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    n, spread = len(points), len(points) * sum(x * x for x in xs) - sum(xs) ** 2
    slope = (n * sum(x * y for x, y in points) - sum(xs) * sum(ys)) / spread if spread else 0.0
    return slope, (sum(ys) - slope * sum(xs)) / n


def brute(series, until, steps):
    """Forecasts for ``steps`` from the months up to ``until`` of one market."""
    seen = {t: y for t, y in series.items() if t <= until}
    ratios = {}
    for t, y in seen.items():
        if all(t + k in seen for k in range(-6, 7)):
            mean = (sum(seen[t + k] for k in range(-5, 6)) + (seen[t - 6] + seen[t + 6]) / 2) / 12
            ratios.setdefault(t % 12, []).append(y / mean)
    raw = {c: statistics.mean(v) for c, v in ratios.items()}
    mean = statistics.mean(raw.values()) if raw else 1.0
    index = {c: v / mean for c, v in raw.items()}
    slope, level = line([(t, y / index.get(t % 12, 1.0)) for t, y in seen.items()])
    return {t: (level + slope * t) * index.get(t % 12, 1.0) for t in steps}


def test_forecast_against_plain_python(spark):
    base = 12 * 25
    series = {t: (50 + 0.4 * (t - base)) * (1 + 0.2 * ((t * 7) % 12 - 5.5) / 12) + ((t * 31) % 17) / 10 for t in range(base, base + 40)}
    del series[base + 30]  # a gap: thirteen moving means are not whole
    rows = [(day(t, d), "A", y + s) for t, y in series.items() for d, s in ((1, 1.0), (20, -1.0))]
    got = seasonal.seasonal_forecast(spark.createDataFrame(rows, ROWS)).collect()
    last = max(series)
    held, ahead = brute(series, last - 3, range(last - 2, last + 1)), brute(series, last, range(last + 1, last + 4))
    assert {(r.kind, r.month): r.forecast for r in got} == pytest.approx(
        {("holdout", day(t)): v for t, v in held.items()} | {("ahead", day(t)): v for t, v in ahead.items()}, abs=1e-3)
    errors = {day(t): 100 * abs(v - series[t]) / series[t] for t, v in held.items()}
    assert {r.month: r.error_pct for r in got if r.kind == "holdout"} == pytest.approx(errors, abs=1e-3)
    assert [r.holdout_mape for r in got] == pytest.approx([statistics.mean(errors.values())] * len(got), abs=1e-3)


def test_a_seasonal_series_is_forecast_exactly(spark):
    season = [0.8, 0.9, 1.0, 1.1, 1.2, 1.0, 0.9, 1.1, 1.3, 0.7, 1.0, 1.0]
    rows = [(day(t), "A", 100.0 * season[t % 12]) for t in range(360, 400)]
    got = seasonal.seasonal_forecast(spark.createDataFrame(rows, ROWS)).collect()
    assert {r.month: r.forecast for r in got} == pytest.approx({day(t): 100 * season[t % 12] for t in range(397, 403)}, rel=0.002)
    assert max(r.holdout_mape for r in got) < 0.2


def test_short_series_nulls_and_empty_table(spark):
    rows = [(day(360), "one", 5.0), (day(360), "one", None), (None, "one", None), (day(361), None, 4.0), (day(361), "none", None)]
    got = seasonal.seasonal_forecast(spark.createDataFrame(rows, ROWS)).collect()
    assert [(r.kind, r.forecast, r.seasonal_index, r.holdout_mape) for r in got] == [("ahead", 5.0, 1.0, None)] * 3
    assert seasonal.seasonal_forecast(spark.createDataFrame([], ROWS)).count() == 0
