"""Series, decomposition, anomalies, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import timeseries as ts
from ..facts import order_revenue, sales
from .registry import R, query, tidy, with_sales

SERIES_SQL = """daily AS (SELECT date AS ds, sum(total_amount) AS v FROM sales GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM daily),
series AS (SELECT s.ds, coalesce(v, 0) AS y FROM spine s LEFT JOIN daily d ON s.ds = d.ds)"""


def _sql(body: str, *ctes: str) -> str:
    return with_sales(body, SERIES_SQL, *ctes)


def _rows(spark, folder):
    return order_revenue(spark, folder, ["date", "total_amount"])


def _days(spark, folder):
    return ts.resample(_rows(spark, folder), "D")


@query(_sql(f"SELECT ds, {R('y')} AS y FROM series"))
def daily_spine(spark, folder):
    return tidy(_days(spark, folder))


def _register_resample(unit: str, word: str, label: str) -> None:
    @query(
        with_sales(
            f"SELECT {label} AS ds, {R('coalesce(v, 0)')} AS y FROM spine LEFT JOIN known USING (b)",
            f"known AS (SELECT CAST(date_trunc('{word}', date) AS DATE) AS b, sum(total_amount) AS v FROM sales GROUP BY 1)",
            f"spine AS (SELECT CAST(unnest(generate_series(min(b), max(b), INTERVAL 1 {word.upper()})) AS DATE) AS b FROM known)",
        ),
        name=f"resample_{word}",
    )
    def run(spark, folder):
        return tidy(ts.resample(_rows(spark, folder), unit))


_register_resample("W", "week", "b + 6")
_register_resample("M", "month", "last_day(b)")


def _trailing(n: int, fn: str = "avg") -> str:
    w = f"OVER (ORDER BY ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(y) {w} = {n} THEN {fn}(y) {w} END"


@query(_sql(f"SELECT ds, {R('y')} AS y, " + ", ".join(f"{R(_trailing(n))} AS ma{n}" for n in (3, 7, 30)) + " FROM series"))
def moving_avg(spark, folder):
    return tidy(ts.moving_averages(_days(spark, folder)))


@query(
    _sql(
        f"""SELECT ds, {R('y')} AS y, {R('m')} AS mean, {R('s')} AS std, {R('m + 2 * s')} AS upper,
        {R('CASE WHEN s IS NOT NULL THEN greatest(0, m - 2 * s) END')} AS lower
        FROM (SELECT ds, y, {_trailing(3)} AS m, {_trailing(3, 'stddev_samp')} AS s FROM series)"""
    )
)
def bollinger(spark, folder):
    return tidy(ts.volatility_band(_days(spark, folder)))


@query(
    _sql(
        f"""SELECT ds, {R('y')} AS y, {R('lag(y) OVER (ORDER BY ds)')} AS previous,
        {R('(y - lag(y) OVER (ORDER BY ds)) / nullif(lag(y) OVER (ORDER BY ds), 0)', 6)} AS change FROM series"""
    )
)
def change_rate(spark, folder):
    return tidy(ts.change_rate(_days(spark, folder)), change=6)


def _centered(n: int) -> str:
    after = n // 2 if n % 2 else n // 2 - 1
    w = f"OVER (ORDER BY ds ROWS BETWEEN {n // 2} PRECEDING AND {after} FOLLOWING)"
    return f"CASE WHEN count(y) {w} = {n} THEN avg(y) {w} END"


def _parts_sql(period: int) -> str:
    return f"""placed AS (SELECT ds, y, {_centered(max(7, period // 2))} AS trend, row_number() OVER (ORDER BY ds) - 1 AS i FROM series),
  seasoned AS (SELECT ds, y, trend, i, coalesce(avg(y - trend) OVER (PARTITION BY i % {period}), 0) AS seasonal FROM placed),
  parts AS (SELECT ds, y, trend, seasonal, y - trend - seasonal AS residual FROM seasoned)"""


PART_COLUMNS = f"SELECT ds, {R('y')} AS y, {R('trend')} AS trend, {R('seasonal')} AS seasonal, {R('residual')} AS residual FROM parts"


@query(_sql(PART_COLUMNS, _parts_sql(12)))
def decomposition(spark, folder):
    return tidy(ts.decompose(_days(spark, folder), 12))


@query(_sql(PART_COLUMNS, _parts_sql(16)))
def decomposition_even_window(spark, folder):
    return tidy(ts.decompose(_days(spark, folder), 16))


@query(
    _sql(
        f"""SELECT total_observations, start_date, end_date, {R('mean')} AS mean, {R('std_dev')} AS std_dev, {R('lo')} AS min, {R('hi')} AS max,
        CASE WHEN l > f THEN 'Upward' ELSE 'Downward' END AS trend_direction, {R('100 * (l - f) / f', 4)} AS trend_change_pct,
        {R('tv')} AS trend_volatility, {R('sv / bv', 4)} AS seasonal_strength, {R('amp')} AS seasonal_amplitude,
        {R('rm', 2)} AS residual_mean, {R('rs')} AS residual_std, {R('ac', 4)} AS residual_autocorrelation,
        CASE WHEN sv / bv > 0.3 THEN 'Strong' WHEN sv / bv > 0.1 THEN 'Moderate' ELSE 'Weak' END AS seasonality,
        {R('100 * rs / std_dev', 4)} AS unexplained_pct FROM
        (SELECT count(*) AS total_observations, min(ds) AS start_date, max(ds) AS end_date, avg(y) AS mean, stddev_samp(y) AS std_dev,
          min(y) AS lo, max(y) AS hi, arg_min(trend, ds) FILTER (trend IS NOT NULL) AS f, arg_max(trend, ds) FILTER (trend IS NOT NULL) AS l,
          stddev_samp(trend) AS tv, var_pop(seasonal) FILTER (seasonal <> 0) AS sv, var_pop(seasonal + residual) FILTER (seasonal <> 0) AS bv,
          max(seasonal) FILTER (seasonal <> 0) - min(seasonal) FILTER (seasonal <> 0) AS amp, avg(residual) AS rm, stddev_samp(residual) AS rs,
          corr(residual, before) AS ac
         FROM (SELECT *, lag(residual) OVER (ORDER BY ds) AS before FROM parts))""",
        _parts_sql(12),
    )
)
def decomposition_stats(spark, folder):
    four = {c: 4 for c in ("trend_change_pct", "seasonal_strength", "residual_autocorrelation", "unexplained_pct")}
    return tidy(ts.decomposition_stats(_days(spark, folder), 12), **four)


@query(_sql(f"SELECT {R('corr(y, before)', 4)} AS autocorrelation FROM (SELECT y, lag(y, 7) OVER (ORDER BY ds) AS before FROM series)"))
def autocorr(spark, folder):
    return tidy(ts.autocorrelation(_days(spark, folder), lag=7), 4)


RUNS_SQL = """indexed AS (SELECT ds, v AS y, row_number() OVER (ORDER BY ds) - 1 AS i,
    CASE WHEN count(v) OVER w = 30 THEN avg(v) OVER w END AS ma FROM daily WINDOW w AS (ORDER BY ds ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
turned AS (SELECT ds, y, i, CASE WHEN ma > before THEN 'Uptrend' ELSE 'Downtrend' END AS trend FROM
    (SELECT *, lag(ma) OVER (ORDER BY ds) AS before FROM indexed) WHERE before IS NOT NULL),
starts AS (SELECT * FROM (SELECT *, lag(trend) OVER (ORDER BY ds) AS p FROM turned) WHERE p IS NULL OR p <> trend),
runs AS (SELECT trend, i AS start_idx, lead(i) OVER (ORDER BY i) AS end_idx, ds AS start_date, y AS start_value, lead(y) OVER (ORDER BY i) AS end_value FROM starts)"""


@query(
    _sql(
        f"""SELECT trend, start_idx, end_idx, start_date, end_idx - start_idx AS duration_days, {R('start_value')} AS start_value,
        {R('end_value')} AS end_value, {R('100 * (end_value - start_value) / start_value', 4)} AS change_pct, end_idx IS NOT NULL AS closed FROM runs""",
        RUNS_SQL,
    )
)
def trend_runs(spark, folder):
    return tidy(ts.trend_runs(_rows(spark, folder)), change_pct=4)


# ---- anomalies ----

ANOMALY_SQL = """spread AS (SELECT avg(total_amount) AS m, stddev_samp(total_amount) AS s, count(*) AS n FROM sales),
odd AS (SELECT date, transaction_id, total_amount, abs((total_amount - m) / s) AS z, total_amount - m AS dev, m FROM sales, spread
  WHERE abs((total_amount - m) / s) > 2.0)"""
ANOMALY_COLUMNS = f"""SELECT date, transaction_id, {R('total_amount')} AS total_amount, {R('z', 4)} AS zscore, {R('dev')} AS deviation,
  {R('100 * dev / m', 4)} AS deviation_pct, CASE WHEN total_amount > m THEN 'spike' ELSE 'drop' END AS type"""


def _lines(spark, folder):
    return sales(spark, folder, ["date", "transaction_id", "total_amount"]).withColumn("date", F.to_date("date"))


@query(with_sales(ANOMALY_COLUMNS + " FROM odd", ANOMALY_SQL))
def anomalies_all(spark, folder):
    return tidy(ts.flag_anomalies(_lines(spark, folder)), zscore=4, deviation_pct=4)


@query(
    with_sales(
        ANOMALY_COLUMNS + ", row_number() OVER (ORDER BY z DESC, transaction_id) AS rank FROM odd ORDER BY z DESC, transaction_id LIMIT 20",
        ANOMALY_SQL,
    )
)
def zscore_anomalies(spark, folder):
    return tidy(ts.top_anomalies(_lines(spark, folder), ties=("transaction_id",)), zscore=4, deviation_pct=4)


@query(
    with_sales(
        f"""SELECT min(n) AS total_transactions, (SELECT count(*) FROM odd) AS total_anomalies,
        {R('100.0 * (SELECT count(*) FROM odd) / min(n)', 4)} AS anomaly_rate, {R('min(m)')} AS mean_amount, {R('min(s)')} AS std_deviation,
        CAST(2.0 AS DOUBLE) AS sensitivity_threshold FROM spread""",
        ANOMALY_SQL,
    )
)
def anomaly_summary(spark, folder):
    return tidy(ts.anomaly_summary(_lines(spark, folder)), anomaly_rate=4)


# ---- forecasts ----


def _state_sql(source: str) -> str:
    return f"""clean AS (SELECT ds, y, row_number() OVER (ORDER BY ds DESC) - 1 AS back,
    y - CASE WHEN count(y) OVER w = 7 THEN avg(y) OVER w END AS off FROM {source} WHERE y > 0
    WINDOW w AS (ORDER BY ds ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  state AS (SELECT (SELECT max(ds) FROM {source}) AS last_date, count(*) AS points, avg(y) AS hm, stddev_samp(y) AS hs,
    sum(0.3 * pow(0.7, back) * y) + pow(0.7, count(*)) * avg(y) AS level, stddev_samp(off) AS spread,
    (arg_max(y, ds) - arg_min(y, ds) FILTER (back < 30)) / 30 AS slope FROM clean)"""


def _ahead_sql(n: int) -> str:
    return f"""ahead AS (SELECT i AS step, last_date + CAST(i AS INTEGER) AS date, greatest(level + slope * i, 0) AS f, spread, hm, hs, points, last_date
    FROM state, (SELECT unnest(generate_series(1, {n})) AS i))"""


@query(
    _sql(
        f"""SELECT step, date, {R('f')} AS forecast, {R('f + 1.96 * spread')} AS upper_bound_95,
        {R('greatest(0, f - 1.96 * spread)')} AS lower_bound_95 FROM ahead""",
        _state_sql("series"),
        _ahead_sql(30),
    )
)
def ses_forecast(spark, folder):
    out = ts.smooth_forecast(_days(spark, folder), 30)
    return tidy(out.select("step", "date", "forecast", "upper_bound_95", "lower_bound_95"))


@query(
    _sql(
        f"""SELECT CAST(30 AS BIGINT) AS forecast_period_days, {R('sum(f)')} AS total_forecasted_sales, {R('avg(f)')} AS average_daily_forecast,
        CASE WHEN avg(f) FILTER (step > 23) > avg(f) FILTER (step <= 7) THEN 'Upward' ELSE 'Downward' END AS trend,
        {R('100 * (avg(f) FILTER (step > 23) - avg(f) FILTER (step <= 7)) / avg(f) FILTER (step <= 7)', 4)} AS trend_change_pct,
        {R('max(hm)')} AS historical_mean, {R('max(hs)')} AS historical_std, {R('stddev_samp(f)')} AS forecast_std,
        max(last_date) AS forecast_start_date, max(date) AS forecast_end_date, max(points) AS historical_data_points,
        {R('100 * (avg(f) - max(hm)) / max(hm)', 4)} AS growth_vs_history FROM ahead""",
        _state_sql("series"),
        _ahead_sql(30),
    )
)
def ses_forecast_summary(spark, folder):
    return tidy(ts.forecast_summary(_days(spark, folder), 30), trend_change_pct=4, growth_vs_history=4)


@query(
    _sql(
        f"""SELECT count(*) AS days, {R('100 * avg(CASE WHEN s.y <> 0 THEN abs(s.y - f) / s.y END)', 4)} AS mape
        FROM series s JOIN ahead ON s.ds = ahead.date""",
        "history AS (SELECT * FROM series WHERE ds <= (SELECT max(ds) FROM series) - 30)",
        _state_sql("history"),
        _ahead_sql(30),
    )
)
def forecast_backtest(spark, folder):
    return tidy(ts.forecast_backtest(_days(spark, folder), 30), 4)


@query(
    with_sales(
        f"""SELECT step, {R('slope')} AS slope, {R('intercept')} AS intercept, {R('sqrt((syy - slope * sxy) / n)')} AS rmse,
        {R('intercept + slope * (n - 1 + step)')} AS forecast
        FROM (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS n, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM monthly),
          (SELECT unnest(generate_series(1, 3)) AS step)""",
        "monthly AS (SELECT sum(total_amount) AS y, row_number() OVER (ORDER BY date_trunc('month', date)) - 1 AS x FROM sales GROUP BY date_trunc('month', date))",
    )
)
def linear_trend_forecast(spark, folder):
    out = ts.linear_trend(ts.resample(_rows(spark, folder), "M"))
    return tidy(out.select("step", "slope", "intercept", F.sqrt("mse").alias("rmse"), "forecast"))
