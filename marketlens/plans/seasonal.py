"""TB-7 seasonal adjustment and hold-out error (our definition).

Monthly means per market are divided by a centred 2x12 moving mean; the mean ratio of a
calendar month, scaled so that a market's indices average one, is its seasonal index.  The
trend is a least-squares line through the *adjusted* series (mean / index), and a forecast is
line times index.  The same fit runs twice: without the last ``holdout`` calendar months,
whose forecasts are compared with what was observed, and with all months, for the
``horizon`` months ahead.

Defined cases: a month whose moving mean lacks one of its thirteen months gives no ratio; a
calendar month without a ratio has index 1; fewer than two months give slope 0; a market
whose months all lie in the hold-out has no hold-out rows; hold-out months that were not
observed are left out; an error against an observed mean of 0 is null; a null price counts
in no mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import exact_avg
from marketlens.session import materialize

EXACT = "decimal(38,9)"  # sums at nine places do not depend on the order of the rows
HALF_YEAR = 6


def month_number(month: Column) -> Column:
    """Months since 1970-01."""
    return ((F.year(month) - 1970) * 12 + F.month(month) - 1).cast("int")


def month_date(t: Column) -> Column:
    return F.make_date(F.floor(t / 12).cast("int") + 1970, (t % 12).cast("int") + 1, F.lit(1))


def _sum(c: Column) -> Column:
    return F.sum(c.cast(EXACT))


def seasonal_ratios(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """``monthly`` (keys, ``t``, ``y``) with ``ratio``: y over the centred 2x12 mean, null where the mean is not whole."""
    series = Window.partitionBy(*keys).orderBy("t")
    wide, near = series.rangeBetween(-HALF_YEAR, HALF_YEAR), series.rangeBetween(-HALF_YEAR + 1, HALF_YEAR - 1)
    # The outer two months count half each.
    centred = (_sum(F.col("y")).over(wide).cast("double") + _sum(F.col("y")).over(near).cast("double")) / 24
    whole = F.count("y").over(wide) == 2 * HALF_YEAR + 1
    return monthly.withColumn("ratio", F.when(whole & (centred != 0), F.col("y") / centred))


def seasonal_index(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, ``cal`` (0 to 11) and ``season``; the indices of one series average one."""
    by_month = ratios.filter("ratio IS NOT NULL").groupBy(*keys, (F.col("t") % 12).alias("cal")).agg(
        (_sum(F.col("ratio")).cast("double") / F.count("ratio")).alias("raw"))
    whole = Window.partitionBy(*keys)
    mean = _sum(F.col("raw")).over(whole).cast("double") / F.count("raw").over(whole)
    return by_month.select(*keys, "cal", F.when(mean != 0, F.col("raw") / mean).otherwise(1.0).alias("season"))


def trend(adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares line of ``a`` over ``t``: keys, ``slope``, ``level`` (at t = 0)."""
    x, y = F.col("t"), F.col("a")
    sums = adjusted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        _sum(y).cast("double").alias("sy"), _sum(x * y).cast("double").alias("sxy"))
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    line = sums.withColumn("slope", F.when(spread != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0))
    return line.select(*keys, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("level"))


def seasonal_forecast(tracking: DataFrame, horizon: int = 3, holdout: int = 3) -> DataFrame:
    """Per market: the hold-out months with observed mean and error, then the months ahead.

    ``holdout_mape`` is the market's mean absolute error over its hold-out months, in percent.
    """
    monthly = tracking.groupBy("market", F.trunc("tracking_date", "month").alias("month")).agg(
        exact_avg("competitor_price_usd").alias("y")).filter("y IS NOT NULL AND market IS NOT NULL")
    # One row a market and month: written once, since both fits and the errors read it.
    monthly = materialize(monthly.select("market", month_number(F.col("month")).alias("t"), "y"), "seasonal-months")
    last = monthly.groupBy("market").agg(F.max("t").alias("last"))
    keys = ["market", "kind"]
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(back).alias("back"), F.lit(ahead).alias("ahead"))
                      for kind, back, ahead in (("holdout", holdout, holdout), ("ahead", 0, horizon))])
    fits = last.select("market", "last", F.explode(kinds).alias("k")).select(
        "market", "k.kind", (F.col("last") - F.col("k.back")).alias("until"), "k.ahead")
    seen = monthly.join(fits, "market").filter(F.col("t") <= F.col("until")).select(*keys, "t", "y")
    season = seasonal_index(seasonal_ratios(seen, keys), keys)
    index = F.coalesce(F.col("season"), F.lit(1.0))
    adjusted = seen.withColumn("cal", F.col("t") % 12).join(season, [*keys, "cal"], "left").select(
        *keys, "t", F.when(index != 0, F.col("y") / index).otherwise(F.col("y")).alias("a"))
    steps = fits.select(*keys, F.explode(F.sequence(F.col("until") + 1, F.col("until") + F.col("ahead"))).alias("t"))
    steps = steps.withColumn("cal", F.col("t") % 12)
    out = steps.join(trend(adjusted, keys), keys).join(season, [*keys, "cal"], "left")
    out = out.join(monthly.select("market", "t", F.col("y").alias("actual")), ["market", "t"], "left")
    out = out.filter("kind = 'ahead' OR actual IS NOT NULL")
    line = F.col("level") + F.col("slope") * F.col("t")
    out = out.withColumns({"index": index, "line": line}).withColumn("predicted", F.col("line") * F.col("index"))
    error = F.lit(100.0) * F.abs(F.col("predicted") - F.col("actual")) / F.nullif(F.abs(F.col("actual")), F.lit(0.0))
    out = out.withColumn("error", F.when(F.col("kind") == "holdout", error))
    whole = Window.partitionBy("market")  # a handful of rows a market
    mape = _sum(F.col("error")).over(whole).cast("double") / F.nullif(F.count("error").over(whole), F.lit(0))
    return out.select(
        "market", "kind", month_date(F.col("t")).alias("month"), F.round("index", 4).alias("seasonal_index"),
        F.round("line", 4).alias("trend"), F.round("predicted", 4).alias("forecast"),
        F.when(F.col("kind") == "holdout", F.round("actual", 4)).alias("actual"),
        F.round("error", 4).alias("error_pct"), F.round(mape, 4).alias("holdout_mape"))
