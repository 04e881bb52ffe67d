"""Streaming jobs over the events, checked against the batch answer."""

from __future__ import annotations

from ...streaming import live
from .registry import R, query, tidy

DAYS_SQL = """days AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS v, avg(value) AS a, max(value) AS m FROM events GROUP BY 1)"""


def _events(spark, folder):
    return live.event_stream(spark, folder, "events.parquet")


@query(
    f"WITH {DAYS_SQL} SELECT d AS window_start, n AS events, {R('v')} AS total_value, {R('a')} AS average_value, {R('m')} AS max_value FROM days"
)
def live_kpis(spark, folder):
    return tidy(live.refresh_kpis(_events(spark, folder)))


@query(
    f"""WITH {DAYS_SQL}, changes AS (SELECT d, v, 100 * (v - lag(v) OVER (ORDER BY d)) / nullif(lag(v) OVER (ORDER BY d), 0) AS c FROM days)
    SELECT d AS window_start, {R('v')} AS total_value, {R('c', 4)} AS change_pct,
    CASE WHEN c > 20 THEN 'spike' WHEN c < -20 THEN 'drop' ELSE 'normal' END AS alert FROM changes"""
)
def live_alerts(spark, folder):
    return tidy(live.refresh_alerts(_events(spark, folder)), change_pct=4)
