"""Windows and forecasts against pandas and plain loops."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ml
from ledgerlens.operators import timeseries as ts


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(11)
    days = pd.date_range("2024-01-01", periods=120, freq="D")
    y = 100 + np.arange(120) * 0.5 + 20 * np.sin(np.arange(120) / 3) + rng.normal(0, 5, 120)
    y[[10, 11, 40]] = 0.0
    return pd.Series(y, index=days)


@pytest.fixture(scope="module")
def fact(spark, values):
    rows = [(d.date(), float(v)) for d, v in values.items() if v != 0]
    return spark.createDataFrame(rows, "date date, total_amount double")


def column(df, name, key="ds"):
    return [r[name] for r in df.orderBy(key).collect()]


def same(got, want):
    got = np.array([np.nan if v is None else v for v in got], dtype=float)
    assert np.allclose(got, np.asarray(want, dtype=float), equal_nan=True, rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("unit, rule", [("D", "D"), ("W", "W"), ("M", "ME")])
def test_resample(fact, values, unit, rule):
    out = ts.resample(fact, unit).orderBy("ds").collect()
    want = values.resample(rule).sum()
    assert [str(r["ds"]) for r in out] == [str(d.date()) for d in want.index]
    same([r["y"] for r in out], want)


@pytest.mark.parametrize("n", [3, 7, 8, 30])
def test_moving_means(fact, values, n):
    days = ts.resample(fact, "D")
    same(column(days.select("ds", ts.moving_mean(F.col("y"), n).alias("m")), "m"), values.rolling(n).mean())
    same(column(days.select("ds", ts.moving_std(F.col("y"), n).alias("m")), "m"), values.rolling(n).std())
    same(column(days.select("ds", ts.centered_mean(F.col("y"), n).alias("m")), "m"), values.rolling(n, center=True).mean())


@pytest.mark.parametrize("period", [12, 16])
def test_decomposition(fact, values, period):
    out = ts.decompose(ts.resample(fact, "D"), period)
    trend = values.rolling(max(7, period // 2), center=True).mean()
    slot = np.arange(len(values)) % period
    seasonal = (values - trend).groupby(slot).transform("mean").fillna(0)
    same(column(out, "trend"), trend)
    same(column(out, "seasonal"), seasonal)
    same(column(out, "residual"), values - trend - seasonal)


def test_decomposition_figures(fact, values):
    row = ts.decomposition_stats(ts.resample(fact, "D"), 12).first()
    trend = values.rolling(7, center=True).mean().dropna()
    residual = pd.Series(column(ts.decompose(ts.resample(fact, "D"), 12), "residual"), dtype=float).dropna()
    assert row.trend_direction == "Upward"
    assert row.trend_change_pct == pytest.approx((trend.iloc[-1] - trend.iloc[0]) / trend.iloc[0] * 100)
    assert row.residual_autocorrelation == pytest.approx(residual.corr(residual.shift(1)))


def test_autocorrelation(fact, values):
    for lag in (1, 5):
        got = ts.autocorrelation(ts.resample(fact, "D"), lag=lag).first()[0]
        assert got == pytest.approx(values.corr(values.shift(lag)))


def test_smoothing_is_the_fold(fact, values):
    clean = values[values > 0]
    level = clean.mean()
    for v in clean:
        level = 0.3 * v + 0.7 * level
    tail = clean.tail(30)
    slope = (tail.iloc[-1] - tail.iloc[0]) / 30
    spread = (clean - clean.rolling(7).mean()).dropna().std()
    out = ts.smooth_forecast(ts.resample(fact, "D"), 10).orderBy("step").collect()
    for i, r in enumerate(out, 1):
        value = max(level + slope * i, 0)
        assert r.forecast == pytest.approx(value)
        assert r.upper_bound_95 == pytest.approx(value + 1.96 * spread)
        assert r.lower_bound_95 == pytest.approx(max(0, value - 1.96 * spread))
    assert str(out[0].date) == "2024-04-30"


def test_forecast_needs_seven_points(spark):
    rows = [(f"2024-01-0{i}", 1.0) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "date string, total_amount double").withColumn("date", F.to_date("date"))
    assert ts.smooth_forecast(ts.resample(df, "D")).count() == 0


def test_trend_runs_against_a_loop(fact, values):
    y = values[values != 0]
    window = 10
    ma = y.rolling(window).mean().to_numpy()
    runs, current, start = [], None, 0
    for i in range(window, len(ma)):
        trend = "Uptrend" if ma[i] > ma[i - 1] else "Downtrend"
        if trend != current:
            if current:
                runs.append((current, start, i, i - start))
            current, start = trend, i
    out = ts.trend_runs(fact, window).orderBy("start_idx").collect()
    assert [(r.trend, r.start_idx, r.end_idx, r.duration_days) for r in out if r.closed] == runs
    assert [(r.trend, r.start_idx) for r in out if not r.closed] == [(current, start)]


def test_linear_trend(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}-15", 10.0 + 3 * m) for m in range(1, 7)], "date string, total_amount double")
    out = ts.linear_trend(ts.resample(df.withColumn("date", F.to_date("date")), "M")).orderBy("step").collect()
    assert [round(r.forecast, 6) for r in out] == [31.0, 34.0, 37.0]
    assert out[0].mse == pytest.approx(0.0, abs=1e-9)


def test_arima_recovers_a_process(spark):
    rng = np.random.default_rng(5)
    d = [0.0]
    for _ in range(300):
        d.append(0.6 * d[-1] + rng.normal(0, 1))
    y = 1000 + np.cumsum(d)
    days = pd.date_range("2000-01-31", periods=len(y), freq="ME")
    rows = [("r", x.date(), float(v)) for x, v in zip(days, y)] + [("short", days[0].date(), 7.0)]
    out = ml.arima_forecast(spark.createDataFrame(rows, "region string, ds date, y double"), "region", 3)
    long, short = ([r.forecast for r in out.where(f"region = '{k}'").orderBy("step").collect()] for k in ("r", "short"))
    step = np.diff([y[-1], *long])
    assert 0.5 < step[1] / step[0] < 0.7 and step[2] / step[1] == pytest.approx(step[1] / step[0])
    assert short == [7.0] * 3


def test_weekly_forecast_takes_week_and_month_from_the_date(spark):
    rows = [(datetime.date(2024, 1, 7) + datetime.timedelta(weeks=k), float(k)) for k in range(31)]
    series = spark.createDataFrame(rows, "ds date, y double")
    out = ml.forecast_weeks(ml.train_weekly(series, trees=3), series, steps=6).where("kind = 'forecast'").orderBy("ds").collect()
    assert [r.ds for r in out] == [rows[-1][0] + datetime.timedelta(weeks=k) for k in range(1, 7)]
    assert [r.week for r in out] == [r.ds.isocalendar().week for r in out]


def test_weekly_forecast_is_repeatable(spark, fact):
    series = ts.resample(fact, "W")
    runs = []
    for _ in range(2):
        model = ml.train_weekly(series, trees=5)
        runs.append([tuple(r) for r in ml.forecast_weeks(model, series).where("kind = 'forecast'").orderBy("week").collect()])
    assert runs[0] == runs[1] and len(runs[0]) == 4
