"""Row filters, ranking and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import lit_like
from .scale import one_row


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equality for a single value, membership for a list."""
    for column, value in (filters or {}).items():
        c = F.col(column)
        df = df.where(c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == F.lit(value))
    return df


def in_window(
    df: DataFrame,
    start: str,
    end: str,
    members: dict[str, Sequence[str]] | None = None,
    date: str = "date",
) -> DataFrame:
    """Date range (both ends included) and membership lists."""
    kind = df.schema[date].dataType
    df = df.where(F.col(date).between(lit_like(start, kind), lit_like(end, kind)))
    return apply_filters(df, {k: list(v) for k, v in (members or {}).items()})


def same_text(df: DataFrame, column: str, value: str) -> DataFrame:
    """Case-insensitive equality."""
    return df.where(F.lower(F.col(column).cast("string")) == F.lit(value.lower()))


def last_days(df: DataFrame, days: int | None, date: str = "date") -> DataFrame:
    """Rows of the last ``days`` days up to the newest date; None keeps all.

    The newest date is a one-column pass; its value then reaches the scan as a pushed-down filter.
    """
    if days is None:
        return df
    newest = one_row(df.agg(F.max(date).alias("d")))["d"]
    start = lit_like(newest, df.schema[date].dataType) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(date) >= start)


def drill_down(
    df: DataFrame,
    category: str | None = None,
    customer: str | None = None,
    date_start: str | None = None,
    date_end: str | None = None,
    limit: int = 100,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Newest transactions that pass the optional filters; ``ties`` makes the cut repeatable."""
    if category and "product_category" in df.columns:
        df = same_text(df, "product_category", category)
    if customer:
        df = same_text(df, "customer_id", customer)
    kind = df.schema["date"].dataType
    if date_start:
        df = df.where(F.col("date") >= lit_like(date_start, kind))
    if date_end:
        df = df.where(F.col("date") <= lit_like(date_end, kind))
    return df.orderBy(F.col("date").desc(), *[F.col(c) for c in ties]).limit(limit)


def rank_by(df: DataFrame, metric: str, top_n: int | None = None, order: str = "desc", ties: Sequence[str] = ()) -> DataFrame:
    key = F.col(metric).asc() if order == "asc" else F.col(metric).desc()
    out = df.orderBy(key, *[F.col(c) for c in ties])
    return out.limit(top_n) if top_n else out


def left_merge(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join on one key; columns both sides have get a suffix. Without the key on both sides: unchanged."""
    if key not in left.columns or key not in right.columns:
        return left
    shared = [c for c in right.columns if c in left.columns and c != key]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, key, "left")


def merge_departments(sales: DataFrame, finance: DataFrame, hr: DataFrame) -> DataFrame:
    return left_merge(left_merge(sales, finance, "date"), hr, "employee_id")


def keep_members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def union_distinct(frames: Sequence[DataFrame], subset: Sequence[str] | None = None) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.dropDuplicates(list(subset)) if subset else out.distinct()


def first_spelling(df: DataFrame, text: str, position: str) -> DataFrame:
    """Case-insensitive dedupe that keeps the earliest spelling; aggregation only, no sort per group."""
    return (
        df.groupBy(F.lower(F.col(text)).alias("__key"))
        .agg(F.min_by(F.col(text), F.col(position)).alias(text), F.min(position).alias(position))
        .drop("__key")
    )
