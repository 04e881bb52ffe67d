"""Cleaning, projection and derived columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import (
    clean_dimension,
    is_number,
    is_time,
    sanitize_text,
    squeeze,
    to_number,
    to_time,
)
from .scale import every, exact_quantiles, one_row

# Source names accepted for each column of the chart-ready frame, in order of preference.
VISUAL_SOURCES = {
    "orderdate": ("orderdate", "Date", "date", "Order Date", "transaction_date", "purchase_dt", "transaction date"),
    "sales": ("sales", "Total Amount", "total_amount", "amount", "order_value", "revenue", "net_sales", "total spent"),
    "country": ("country", "Country", "nation", "Region", "region", "Location", "location", "state", "city"),
    "productline": ("productline", "Product Category", "product_category", "category", "item_category", "product", "item", "sku"),
    "customername": ("customername", "Customer Name", "Customer ID", "customer_id", "customer", "client", "buyer"),
    "dealsize": ("dealsize", "deal_size"),
}


def standard_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip().replace(" ", "_") for c in df.columns])


def squeeze_header(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub("blank", " ", name, flags=re.IGNORECASE)).strip() or name


def sanitize(df: DataFrame) -> DataFrame:
    """Clean headers and every text cell; placeholder words become NULL."""
    out = df.toDF(*[squeeze_header(c) for c in df.columns])
    return out.select(
        *[
            sanitize_text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in out.schema.fields
        ]
    )


def dedupe_fill(df: DataFrame, fill: float | str = 0, date: str | None = None) -> DataFrame:
    """Parse the date column, drop repeated rows, fill NULLs (numbers with a number, texts with a text)."""
    if date and date in df.columns and not is_time(df.schema[date].dataType):
        df = df.withColumn(date, to_time(F.col(date)))
    return df.dropDuplicates().fillna(fill)


def add_time_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d).cast("bigint"),
            "month": F.month(d).cast("bigint"),
            "quarter": F.quarter(d).cast("bigint"),
            "month_name": F.date_format(d, "MMMM"),
        }
    )


def add_revenue(df: DataFrame, quantity: str = "quantity", price: str = "price") -> DataFrame:
    if quantity in df.columns and price in df.columns:
        return df.withColumn("revenue", F.col(quantity) * F.col(price))
    return df


def add_profit(df: DataFrame, revenue: str = "revenue", cost: str = "cost") -> DataFrame:
    if revenue in df.columns and cost in df.columns:
        return df.withColumn("profit", F.col(revenue) - F.col(cost))
    return df


def parse_numbers(df: DataFrame, column: str) -> DataFrame:
    if is_number(df.schema[column].dataType):
        return df.withColumn(column, F.col(column).cast("double"))
    return df.withColumn(column, to_number(F.col(column)))


def day_first_wins(df: DataFrame, column: str) -> bool:
    """Decide for the whole column: does reading day before month parse more values?"""
    rates = one_row(
        df.agg(
            F.count(to_time(F.col(column))).alias("month_first"),
            F.count(to_time(F.col(column), day_first=True)).alias("day_first"),
        )
    )
    return rates["day_first"] > rates["month_first"]


def parse_dates(df: DataFrame, column: str, day_first: bool | None = None) -> DataFrame:
    """Parse a text column; without a known order one pass over the column decides it."""
    if is_time(df.schema[column].dataType):
        return df
    order = day_first_wins(df, column) if day_first is None else bool(day_first)
    return df.withColumn(column, to_time(F.col(column), order))


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate that exists, exact names before case-insensitive ones."""
    for name in candidates:
        if name in columns:
            return name
    lowered = {c.lower(): c for c in columns}
    for name in candidates:
        if name.lower() in lowered:
            return lowered[name.lower()]
    return None


def clean_regions(df: DataFrame, region: str = "region", amount: str = "total_amount") -> DataFrame:
    """Trim the region, drop rows without a region or an amount."""
    name = F.trim(F.col(region).cast("string"))
    return df.withColumn(region, name).where(
        F.col(region).isNotNull() & (F.col(region) != "") & (F.lower(F.col(region)) != "nan") & F.col(amount).isNotNull()
    )


def deal_size(df: DataFrame, amount: str = "sales", name: str = "dealsize") -> DataFrame:
    """Small / Medium / Large at the 33 % and 66 % quantiles; no amount counts as Medium."""
    cut = one_row(exact_quantiles(df, amount, {"q33": 0.33, "q66": 0.66}))
    a = F.col(amount)
    if cut["q33"] is None:
        return df.withColumn(name, F.lit("Medium"))
    return df.withColumn(
        name,
        F.when(a.isNull(), "Medium").when(a <= cut["q33"], "Small").when(a <= cut["q66"], "Medium").otherwise("Large"),
    )


def visual_frame(df: DataFrame) -> DataFrame | None:
    """Project any sales table to the chart-ready columns; None without a date or an amount."""
    source = {role: pick_column(df.columns, names) for role, names in VISUAL_SOURCES.items()}
    if source["orderdate"] is None or source["sales"] is None:
        return None
    date, sales = source["orderdate"], source["sales"]
    parsed = [
        (F.col(date) if is_time(df.schema[date].dataType) else to_time(F.col(date))).alias("orderdate"),
        F.col(sales).try_cast("double").alias("sales"),
    ]
    for role in ("country", "productline", "customername"):
        parsed.append((clean_dimension(F.col(source[role])) if source[role] else F.lit(None).cast("string")).alias(role))
    if source["dealsize"]:
        parsed.append(F.col(source["dealsize"]).cast("string").alias("dealsize"))
    frame = df.select(*parsed)
    if not source["dealsize"]:
        frame = deal_size(frame)
    return frame.dropna(subset=["orderdate", "sales"])


def canonical_frame(df: DataFrame, mapping: dict[str, str], day_first: bool | None = None, whole: bool = False) -> DataFrame:
    """Rename sources to their roles, type date and amount, add ``month_year``, drop incomplete rows.

    ``whole`` is for frames of which all columns are read: every cell is parsed once, but unread columns are not spared."""
    renames = {src: role for role, src in mapping.items() if src != role and role not in df.columns}
    out = df.withColumnsRenamed(renames)
    if "date" in out.columns:
        out = parse_dates(out, "date", day_first).withColumn("month_year", F.date_format("date", "yyyy-MM"))
    if "total_amount" in out.columns:
        out = parse_numbers(out, "total_amount")
    if "customer_id" in out.columns:
        out = out.withColumn("customer_id", F.col("customer_id").cast("string"))
    needed = [c for c in ("total_amount", "date", "customer_id") if c in out.columns]
    return complete_rows(out, needed) if whole else out.dropna(subset=needed)


def complete_rows(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """``dropna`` on columns that are costly to compute: a filter would be pushed below them with their expressions, and compute them twice."""
    rows = df.select(F.array(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns])).alias("__row"))
    real = [c for c in needed if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]

    def complete(row):
        return every([row[c].isNotNull() for c in needed] + [~F.isnan(row[c]) for c in real])

    return rows.select(F.inline(F.filter("__row", complete)))


def age_band(age: Column) -> Column:
    """Right-closed bands (0,25], (25,35], (35,45], (45,200]."""
    return (
        F.when((age > 0) & (age <= 25), "18-25")
        .when((age > 25) & (age <= 35), "26-35")
        .when((age > 35) & (age <= 45), "36-45")
        .when((age > 45) & (age <= 200), "46+")
    )


