"""From a query spec (a dict) to a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import apply_filters, last_days, rank_by
from ..operators.kpi import aggregate
from ..operators.timeseries import resample, smooth_forecast

# Words accepted for a metric, and the intent behind an action.
METRIC_WORDS = {
    "sales": "sales",
    "revenue": "sales",
    "income": "sales",
    "amount": "sales",
    "profit": "sales",
    "earnings": "sales",
}
ACTION_INTENTS = {
    "get_top_products": "ranking_query",
    "sales_trend": "sales_query",
    "filtered_search": "sales_query",
    "forecast": "forecast_query",
    "insights": "insight_query",
}
DEFAULT_TOP = 5


def map_metric(metric: str, columns: list[str], amount: str = "total_amount") -> str:
    """Column behind a metric word. ``profit`` means the profit column where there is one."""
    word = metric.lower()
    if word in columns:
        return word
    if word in METRIC_WORDS:
        return amount
    raise ValueError(f"unsupported metric: {metric}")


# What each intent adds to a spec that does not say it.
INTENT_DEFAULTS = {"ranking_query": {"top_n": DEFAULT_TOP}, "forecast_query": {"forecast": True}}
# Fields of a plain spec and where each may come from, the first one given winning.
FIELDS = {
    "metric": ("metric",), "filters": ("filters",), "time": ("time",), "group_by": ("group_by",), "aggregation": ("aggregation",),
    "order": ("order",), "steps": ("steps",), "forecast": ("forecast",), "top_n": ("limit", "top_n"),
}


def plain_spec(spec: dict) -> dict:
    """One spelling for all specs: the given fields under their plain names, over the defaults of the intent."""
    if "metric" not in spec:
        raise ValueError("a query spec needs a metric")
    given = {field: next((spec[k] for k in sources if k in spec), None) for field, sources in FIELDS.items()}
    intent = ACTION_INTENTS.get(spec["action"], spec.get("intent")) if "action" in spec else spec.get("intent")
    return INTENT_DEFAULTS.get(intent, {}) | {field: value for field, value in given.items() if value}


def run_query(df: DataFrame, spec: dict) -> DataFrame:
    """Filter, group, aggregate, rank; or forecast the filtered series by day.

    ``time`` is a number of days back from the newest date. Ties rank by the
    group keys, so a cut is repeatable.
    """
    q = plain_spec(spec)
    metric = map_metric(q["metric"], df.columns)
    df = apply_filters(last_days(df, q.get("time")), q.get("filters"))
    if q.get("forecast"):
        return smooth_forecast(resample(df, "D", amount=metric), int(q.get("steps", 30)))
    by = q.get("group_by")
    if not by:
        return rank_by(df, metric, q.get("top_n"), q.get("order", "desc")) if q.get("top_n") else df
    keys = [by] if isinstance(by, str) else list(by)
    grouped = aggregate(df, keys, metric, q.get("aggregation", "sum"))
    if not q.get("top_n"):
        return grouped
    return rank_by(grouped, metric, q["top_n"], q.get("order", "desc"), ties=keys)


def top_row_insight(ranked: DataFrame, metric: str, label: str) -> DataFrame:
    """The member with the highest metric of a ranked frame; nulls when it is empty."""
    best = F.struct(F.col(metric))
    return ranked.agg(F.lit(metric).alias("metric"), F.max_by(F.col(label).cast("string"), best).alias("highest"), F.max(metric).alias("value"))
