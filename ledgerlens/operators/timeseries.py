"""Time series over an aggregated fact.

The fact shrinks to one row per day (week, month) first. Windows without
PARTITION BY run on that series only, whose length is the calendar, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.edge import long_count, percent, ratio, zero_if_null
from ..session import materialize
from .scale import one_row, top_n

def by_day():
    return W.orderBy("ds")

# Resample units: bucket of a date, label of a bucket (weeks end on Sunday, months on their last day).
UNITS = {
    "D": ("DAY", lambda d: F.to_date(d), lambda b: b),
    "W": ("WEEK", lambda d: F.to_date(F.date_trunc("week", d)), lambda b: F.date_add(b, 6)),
    "M": ("MONTH", lambda d: F.to_date(F.date_trunc("month", d)), lambda b: F.last_day(b)),
}


def resample(df: DataFrame, unit: str = "D", date: str = "date", amount: str = "total_amount") -> DataFrame:
    """(ds, y): sum per period, 0 where a period has no rows.

    Gaps are filled from the next known period (window), so the aggregate is not joined with itself.
    """
    word, bucket, label = UNITS[unit]
    known = (
        df.where(F.col(date).isNotNull() & F.col(amount).isNotNull())
        .groupBy(bucket(F.col(date)).alias("b"))
        .agg(F.sum(amount).alias("v"))
    )
    step = F.expr(f"INTERVAL 1 {word}")
    following = F.lead("b").over(W.orderBy("b"))
    stop = F.coalesce(F.to_date(following - step), F.col("b"))
    return known.withColumn("stop", stop).withColumn("p", F.explode(F.sequence("b", "stop", step))).select(
        label(F.to_date("p")).alias("ds"),
        F.when(F.to_date("p") == F.col("b"), F.col("v")).otherwise(F.lit(0.0)).alias("y"),
    )


def moving_mean(value: Column, n: int, order=None) -> Column:
    """Trailing mean of n values, NULL until there are n."""
    w = (order or by_day()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def moving_std(value: Column, n: int, order=None) -> Column:
    w = (order or by_day()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.stddev_samp(value).over(w))


def centered_mean(value: Column, n: int, order=None) -> Column:
    """Mean of n values around the row; an even window reaches one row further back."""
    w = (order or by_day()).rowsBetween(-(n // 2), n // 2 if n % 2 else n // 2 - 1)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def moving_averages(series: DataFrame, windows: tuple[int, ...] = (3, 7, 30)) -> DataFrame:
    return series.select("ds", "y", *[moving_mean(F.col("y"), n).alias(f"ma{n}") for n in windows])


def volatility_band(series: DataFrame, n: int = 3, width: float = 2.0) -> DataFrame:
    """Moving mean with a band of ``width`` standard deviations, floored at 0."""
    banded = series.select("ds", "y", moving_mean(F.col("y"), n).alias("mean"), moving_std(F.col("y"), n).alias("std"))
    reach = F.col("std") * width
    return banded.select(
        "ds", "y", "mean", "std",
        (F.col("mean") + reach).alias("upper"),
        F.when(F.col("std").isNotNull(), F.greatest(F.lit(0.0), F.col("mean") - reach)).alias("lower"),
    )


def change_rate(series: DataFrame) -> DataFrame:
    before = F.lag("y").over(by_day())
    return series.select("ds", "y", before.alias("previous"), ratio(F.col("y") - before, before).alias("change"))


def decompose(series: DataFrame, period: int = 12) -> DataFrame:
    """Additive parts per day: centred trend, mean detrended value per position in the period, rest."""
    width = max(7, period // 2)
    placed = series.select(
        "ds", "y", centered_mean(F.col("y"), width).alias("trend"),
        (F.row_number().over(by_day()) - 1).alias("i"),
    )
    slot = W.partitionBy(F.pmod("i", F.lit(period)) if period > 0 else F.col("i"))
    seasonal = F.coalesce(F.avg(F.col("y") - F.col("trend")).over(slot), F.lit(0.0))
    return placed.withColumn("seasonal", seasonal).select(
        "ds", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("residual")
    )


def autocorrelation(series: DataFrame, value: str = "y", lag: int = 1) -> DataFrame:
    """Pearson correlation of the series with itself ``lag`` steps earlier; 0 when too short."""
    clean = series.where(F.col(value).isNotNull())
    pairs = clean.select(F.col(value).alias("a"), F.lag(value, lag).over(by_day()).alias("b"))
    return pairs.agg(
        F.coalesce(F.corr(F.when(F.col("b").isNotNull(), F.col("a")), "b"), F.lit(0.0)).alias("autocorrelation")
    )


def decomposition_stats(series: DataFrame, period: int = 12) -> DataFrame:
    """One row of figures about the parts; empty below 3 days or when all values are 0."""
    parts = decompose(series, period)
    rest_before = F.lag("residual").over(by_day())
    parts = parts.withColumn("__before", rest_before)
    shown = F.when(F.col("seasonal") != 0, F.col("seasonal"))
    first_trend = F.min_by("trend", F.when(F.col("trend").isNotNull(), F.col("ds")))
    last_trend = F.max_by("trend", F.when(F.col("trend").isNotNull(), F.col("ds")))
    stats = parts.agg(
        long_count().alias("total_observations"),
        F.min("ds").alias("start_date"),
        F.max("ds").alias("end_date"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std_dev"),
        F.min("y").alias("min"),
        F.max("y").alias("max"),
        F.sum(F.abs("y")).alias("__size"),
        first_trend.alias("__first"),
        last_trend.alias("__last"),
        F.stddev_samp("trend").alias("trend_volatility"),
        F.var_pop(shown).alias("__season"),
        F.var_pop(shown + F.col("residual")).alias("__both"),
        (F.max(shown) - F.min(shown)).alias("seasonal_amplitude"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_std"),
        F.corr(F.when(F.col("__before").isNotNull(), F.col("residual")), "__before").alias("residual_autocorrelation"),
    )
    strength = zero_if_null(ratio(F.col("__season"), F.col("__both")))
    return stats.where((F.col("total_observations") >= 3) & (F.col("__size") > 0)).select(
        "total_observations", "start_date", "end_date", "mean", "std_dev", "min", "max",
        F.when(F.col("__last") > F.col("__first"), "Upward").otherwise("Downward").alias("trend_direction"),
        zero_if_null(percent(F.col("__last") - F.col("__first"), F.col("__first"))).alias("trend_change_pct"),
        zero_if_null(F.col("trend_volatility")).alias("trend_volatility"),
        strength.alias("seasonal_strength"),
        zero_if_null(F.col("seasonal_amplitude")).alias("seasonal_amplitude"),
        "residual_mean", "residual_std",
        zero_if_null(F.col("residual_autocorrelation")).alias("residual_autocorrelation"),
        F.when(strength > 0.3, "Strong").when(strength > 0.1, "Moderate").otherwise("Weak").alias("seasonality"),
        zero_if_null(percent(F.col("residual_std"), F.col("std_dev"))).alias("unexplained_pct"),
    )


def trend_runs(df: DataFrame, window: int = 30, date: str = "date", amount: str = "total_amount") -> DataFrame:
    """Runs of a rising or falling moving mean over the days that have sales (gaps and islands).

    A run ends at the index where the direction changes; the run still open at
    the end has ``closed`` false and no end.
    """
    days = (
        df.where(F.col(date).isNotNull()).groupBy(F.to_date(date).alias("ds")).agg(zero_if_null(F.sum(amount)).alias("y"))
    )
    indexed = days.select("ds", "y", (F.row_number().over(by_day()) - 1).cast("bigint").alias("i"), moving_mean(F.col("y"), window).alias("ma"))
    step = indexed.withColumn("__before", F.lag("ma").over(by_day())).where(F.col("__before").isNotNull())
    turned = step.withColumn("trend", F.when(F.col("ma") > F.col("__before"), "Uptrend").otherwise("Downtrend"))
    starts = turned.withColumn("__new", F.coalesce((F.col("trend") != F.lag("trend").over(by_day())).cast("int"), F.lit(1))).where(
        F.col("__new") == 1
    )
    nxt = W.orderBy("i")
    runs = starts.select(
        "trend",
        F.col("i").alias("start_idx"),
        F.lead("i").over(nxt).alias("end_idx"),
        F.col("ds").alias("start_date"),
        F.col("y").alias("start_value"),
        F.lead("y").over(nxt).alias("end_value"),
    )
    return runs.select(
        "trend", "start_idx", "end_idx", "start_date",
        (F.col("end_idx") - F.col("start_idx")).alias("duration_days"),
        "start_value", "end_value",
        percent(F.col("end_value") - F.col("start_value"), F.col("start_value")).alias("change_pct"),
        F.col("end_idx").isNotNull().alias("closed"),
    )


# ---- anomalies ----


def _spread(df: DataFrame, amount: str) -> dict:
    return one_row(df.agg(F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("std"), long_count().alias("n")))


def flag_anomalies(df: DataFrame, sensitivity: float = 2.0, amount: str = "total_amount", spread: dict | None = None) -> DataFrame:
    """All rows further than ``sensitivity`` standard deviations from the mean."""
    spread = spread or _spread(df, amount)
    mean, std = spread["mean"], spread["std"]
    if not std:
        return df.where(F.lit(False)).withColumns(
            {"zscore": F.lit(0.0), "deviation": F.lit(0.0), "deviation_pct": F.lit(0.0), "type": F.lit("")}
        )
    off = F.col(amount) - F.lit(mean)
    return (
        df.withColumn("zscore", F.abs(off / F.lit(std)))
        .where(F.col("zscore") > sensitivity)
        .withColumns(
            {
                "deviation": off,
                "deviation_pct": zero_if_null(percent(off, F.lit(mean))),
                "type": F.when(F.col(amount) > F.lit(mean), "spike").otherwise("drop"),
            }
        )
    )


def top_anomalies(df: DataFrame, n: int = 20, sensitivity: float = 2.0, amount: str = "total_amount", ties: tuple[str, ...] = ()) -> DataFrame:
    return top_n(flag_anomalies(df, sensitivity, amount), [F.col("zscore").desc(), *[F.col(c) for c in ties]], n)


def anomaly_summary(df: DataFrame, sensitivity: float = 2.0, amount: str = "total_amount") -> DataFrame:
    spread = _spread(df, amount)
    found = flag_anomalies(df, sensitivity, amount, spread).agg(long_count().alias("total_anomalies"))
    return found.select(
        F.lit(spread["n"]).cast("bigint").alias("total_transactions"),
        "total_anomalies",
        zero_if_null(percent(F.col("total_anomalies"), F.lit(spread["n"]))).alias("anomaly_rate"),
        F.lit(spread["mean"]).cast("double").alias("mean_amount"),
        F.lit(spread["std"]).cast("double").alias("std_deviation"),
        F.lit(float(sensitivity)).alias("sensitivity_threshold"),
    )


# ---- forecasts ----

SMOOTHING = 0.3
BAND = 1.96
MIN_POINTS = 7


def smoothing_state(series: DataFrame) -> DataFrame:
    """Level, slope and spread after exponential smoothing of the positive days (one row; none below 7 points).

    The recursive fold s = 0.3 y + 0.7 s, started at the mean, is the weighted
    sum of all values plus the mean times 0.7^n.
    """
    keep = 1.0 - SMOOTHING
    positive = series.withColumn("__last", F.max("ds").over(W.partitionBy())).where(F.col("y") > 0)
    back = F.row_number().over(W.orderBy(F.col("ds").desc())) - 1
    placed = positive.select("ds", "y", "__last", back.alias("back"), (F.col("y") - moving_mean(F.col("y"), 7)).alias("off"))
    recent = F.when(F.col("back") < 30, F.col("ds"))
    slope = (F.max_by("y", "ds") - F.min_by("y", recent)) / 30
    return (
        placed.agg(
            long_count().alias("points"),
            F.max("__last").alias("last_date"),
            F.avg("y").alias("historical_mean"),
            F.stddev_samp("y").alias("historical_std"),
            (F.sum(F.lit(SMOOTHING) * F.pow(F.lit(keep), F.col("back")) * F.col("y")) + F.pow(F.lit(keep), F.count("y")) * F.avg("y")).alias("level"),
            F.coalesce(F.stddev_samp("off"), F.stddev_samp("y")).alias("spread"),
            slope.alias("slope"),
        )
        .where(F.col("points") >= MIN_POINTS)
    )


def smooth_forecast(series: DataFrame, periods: int = 30) -> DataFrame:
    """Daily forecast with a 95 % band, floored at 0."""
    state = smoothing_state(series)
    value = F.greatest(F.col("level") + F.col("slope") * F.col("step"), F.lit(0.0))
    return (
        state.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .select("*", value.alias("forecast"))
        .select(
            F.col("step").cast("bigint").alias("step"),
            F.date_add("last_date", F.col("step")).alias("date"),
            "forecast",
            (F.col("forecast") + BAND * F.col("spread")).alias("upper_bound_95"),
            F.greatest(F.lit(0.0), F.col("forecast") - BAND * F.col("spread")).alias("lower_bound_95"),
            "historical_mean", "historical_std", "points", "last_date",
        )
    )


def forecast_summary(series: DataFrame, periods: int = 30) -> DataFrame:
    f = smooth_forecast(series, periods)
    early = F.avg(F.when(F.col("step") <= 7, F.col("forecast")))
    late = F.avg(F.when(F.col("step") > periods - 7, F.col("forecast")))
    mean = F.max("historical_mean")
    return f.agg(
        F.lit(periods).cast("bigint").alias("forecast_period_days"),
        F.sum("forecast").alias("total_forecasted_sales"),
        F.avg("forecast").alias("average_daily_forecast"),
        F.when(late > early, "Upward").otherwise("Downward").alias("trend"),
        zero_if_null(percent(late - early, early)).alias("trend_change_pct"),
        mean.alias("historical_mean"),
        F.max("historical_std").alias("historical_std"),
        F.stddev_samp("forecast").alias("forecast_std"),
        F.max("last_date").alias("forecast_start_date"),
        F.max("date").alias("forecast_end_date"),
        F.max("points").alias("historical_data_points"),
        percent(F.avg("forecast") - mean, mean).alias("growth_vs_history"),
    ).where(F.col("historical_data_points").isNotNull())


def forecast_backtest(series: DataFrame, holdout: int = 30) -> DataFrame:
    """Forecast the last ``holdout`` days from the days before; mean absolute percentage error."""
    series = materialize(series)
    last = one_row(series.agg(F.max("ds").alias("d")))["d"]
    cut = F.date_sub(F.lit(last), holdout)
    ahead = smooth_forecast(series.where(F.col("ds") <= cut), holdout)
    actual = series.where(F.col("ds") > cut)
    return actual.join(ahead, actual["ds"] == ahead["date"]).agg(
        long_count().alias("days"),
        (100.0 * F.avg(ratio(F.abs(F.col("y") - F.col("forecast")), F.when(F.col("y") != 0, F.col("y"))))).alias("mape"),
    )


def linear_trend(series: DataFrame, steps: int = 3) -> DataFrame:
    """Least-squares line over the index of the periods, its error, and the next values."""
    x = F.row_number().over(by_day()).cast("double") - 1
    points = series.select("y", x.alias("x"))
    sums = points.agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.count("y").cast("double").alias("n"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
    )
    mse = (F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n")
    return sums.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        F.col("step").cast("bigint").alias("step"),
        "slope", "intercept",
        mse.alias("mse"),
        (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"),
    )
