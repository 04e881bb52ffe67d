"""Key figures, trends, breakdowns and short findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.edge import edge_round, long_count, percent, ratio, zero_if_null
from .filters import first_spelling
from .scale import exact_quantiles, first_per_group, one_row, top_n
from ..session import materialize, write_once

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}


def aggregate(df: DataFrame, by: str | Sequence[str], metric: str, how: str = "sum", name: str | None = None) -> DataFrame:
    """Group and aggregate by function name; rows without a group key are left out."""
    if how not in AGGREGATES:
        raise ValueError(f"unsupported aggregation: {how}")
    keys = [by] if isinstance(by, str) else list(by)
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*keys).agg(AGGREGATES[how](metric).alias(name or metric))


def business_kpis(df: DataFrame, amount: str = "total_amount", customer: str = "customer_id", date: str = "date") -> DataFrame:
    """Revenue, mean, customers, rows and date range; 0 customers or no dates where the column is absent."""
    if customer not in df.columns:
        df = df.withColumn(customer, F.lit(None).cast("string"))
    if date not in df.columns:
        df = df.withColumn(date, F.lit(None).cast("timestamp"))
    return df.agg(
        zero_if_null(F.sum(amount)).alias("total_revenue"),
        F.avg(amount).alias("average_order_value"),
        F.count_distinct(customer).alias("unique_customers"),
        long_count().alias("total_orders"),
        F.to_date(F.min(date)).alias("start_date"),
        F.to_date(F.max(date)).alias("end_date"),
    )


def order_value(df: DataFrame, amount: str = "total_amount", order: str = "transaction_id") -> DataFrame:
    """Revenue over distinct orders, 0 when the table has no order column."""
    if order not in df.columns:
        return df.agg(F.lit(0.0).alias("average_order_value")).limit(1)
    return df.agg(ratio(F.sum(amount), F.count_distinct(order)).alias("average_order_value"))


def profit_margin(df: DataFrame, revenue: str = "revenue", profit: str = "profit") -> DataFrame:
    return df.agg(
        F.sum(revenue).alias("revenue"),
        F.sum(profit).alias("profit"),
        zero_if_null(percent(F.sum(profit), F.sum(revenue))).alias("profit_margin"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in columns])


PERIODS = {
    "day": (lambda d: F.to_date(d), lambda p: F.date_format(p, "yyyy-MM-dd")),
    "week": (lambda d: F.to_date(F.date_trunc("week", d)), lambda p: F.date_format(p, "yyyy-MM-dd")),
    "month": (lambda d: F.to_date(F.date_trunc("month", d)), lambda p: F.date_format(p, "yyyy-MM")),
    "quarter": (
        lambda d: F.to_date(F.date_trunc("quarter", d)),
        lambda p: F.concat(F.year(p).cast("string"), F.lit("-Q"), F.quarter(p).cast("string")),
    ),
    "year": (lambda d: F.to_date(F.date_trunc("year", d)), lambda p: F.date_format(p, "yyyy")),
}


def revenue_by_period(df: DataFrame, period: str = "month", amount: str = "total_amount", date: str = "date") -> DataFrame:
    """(period_start, period, revenue); weeks run Monday to Sunday."""
    start, label = PERIODS[period]
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(start(F.col(date)).alias("period_start"))
        .agg(zero_if_null(F.sum(amount)).alias("revenue"))
        .select("period_start", label(F.col("period_start")).alias("period"), "revenue")
    )


def revenue_trend(df: DataFrame, period: str = "month", last: int = 12, **cols) -> DataFrame:
    """The last periods that have sales."""
    return revenue_by_period(df, period, **cols).orderBy(F.col("period_start").desc()).limit(last)


def revenue_by(df: DataFrame, dim: str | Column, name: str = "dimension", amount: str = "total_amount") -> DataFrame:
    key = F.col(dim) if isinstance(dim, str) else dim
    return df.select(key.alias(name), F.col(amount)).where(F.col(name).isNotNull()).groupBy(name).agg(
        zero_if_null(F.sum(amount)).alias("revenue")
    )


def top_categories(df: DataFrame, dim: str = "product_category", n: int = 4, amount: str = "total_amount") -> DataFrame:
    return top_n(revenue_by(df, dim, "name", amount), [F.col("revenue").desc(), F.col("name")], n)


def top_customers(df: DataFrame, n: int = 5, customer: str = "customer_id", amount: str = "total_amount") -> DataFrame:
    base = (
        df.where(F.col(customer).isNotNull())
        .groupBy(customer)
        .agg(F.sum(amount).alias("revenue"), F.count(amount).alias("orders"), F.avg(amount).alias("average"))
    )
    return top_n(base, [F.col("revenue").desc(), F.col(customer)], n)


def growth_table(df: DataFrame, period: str, amount: str = "total_amount", date: str = "date") -> DataFrame:
    """Revenue per period with the change to the period before; months without sales count as 0."""
    by = revenue_by_period(df, period, amount, date)
    if period == "month":
        by = fill_periods(by, "month")
    order = W.orderBy("period_start")
    before = F.lag("revenue").over(order)
    return by.withColumn("growth", ratio(F.col("revenue") - before, before))


def fill_periods(by: DataFrame, unit: str) -> DataFrame:
    """Add the periods between two known ones with revenue 0 (a window over the aggregated series, no join)."""
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    upcoming = F.lead("period_start").over(W.orderBy("period_start"))
    stop = F.coalesce(F.to_date(upcoming - step), F.col("period_start"))
    _, label = PERIODS[unit]
    return (
        by.withColumn("__stop", stop)
        .withColumn("__p", F.explode(F.sequence("period_start", "__stop", step)))
        .select(
            F.to_date("__p").alias("period_start"),
            F.when(F.to_date("__p") == F.col("period_start"), F.col("revenue")).otherwise(F.lit(0.0)).alias("revenue"),
        )
        .select("period_start", label(F.col("period_start")).alias("period"), "revenue")
    )


def mean_growth(df: DataFrame, period: str, name: str, **cols) -> DataFrame:
    return growth_table(df, period, **cols).agg((F.avg("growth") * 100.0).alias(name))


def dashboard_kpis(df: DataFrame, amount: str = "total_amount", order: str = "transaction_id", quantity: str = "quantity", date: str = "date") -> DataFrame:
    """Sales, distinct orders, mean sales, quantity and mean monthly growth, all from one row per order and month."""
    per = write_once(
        df.groupBy(F.col(order).alias("order"), F.trunc(date, "month").alias("month")).agg(
            F.sum(amount).alias("amount"), F.count(amount).alias("n"), F.sum(quantity).alias("quantity")
        )
    )
    growth = mean_growth(per, "month", "average_monthly_growth", amount="amount", date="month")
    return per.agg(
        F.sum("amount").alias("total_sales"),
        F.count_distinct("order").alias("total_orders"),
        ratio(F.sum("amount"), F.sum("n")).alias("average_sales"),
        F.sum("quantity").alias("total_quantity"),
    ).select("*", growth.scalar().alias("average_monthly_growth"))


def spend_tiers(df: DataFrame, customer: str = "customer_id", amount: str = "total_amount") -> DataFrame:
    """Premium (>= q66), Standard (>= q33), Basic, and a Total row."""
    spend = write_once(
        df.where(F.col(customer).isNotNull()).groupBy(customer).agg(zero_if_null(F.sum(amount)).alias("spend"))
    )
    cut = one_row(exact_quantiles(spend, "spend", {"q33": 0.33, "q66": 0.66}))
    tier = F.when(F.col("spend") >= cut["q66"], "Premium").when(F.col("spend") >= cut["q33"], "Standard").otherwise("Basic")
    sized = spend.groupBy(tier.alias("tier")).agg(long_count().alias("customers"), F.sum("spend").alias("revenue"))
    everyone = W.partitionBy()
    tiers = sized.withColumn("percent", edge_round(percent(F.col("customers"), F.sum("customers").over(everyone)), 1))
    total = sized.agg(F.sum("customers").alias("customers"), F.sum("revenue").alias("revenue")).select(
        F.lit("Total").alias("tier"), "customers", "revenue", F.lit(100.0).alias("percent")
    )
    return tiers.unionByName(total)


def member_revenue(df: DataFrame, dims: dict[str, str | Column], amount: str = "total_amount") -> DataFrame:
    """``dimension, member, revenue`` of several dimensions from one scan, written once; members are texts, null ones left out."""
    cells = [
        F.struct(F.lit(label).alias("dimension"), (F.col(dim) if isinstance(dim, str) else dim).cast("string").alias("member"))
        for label, dim in dims.items()
    ]
    rows = df.select(F.col(amount).alias("v"), F.explode(F.array(*cells)).alias("cell")).where(F.col("cell.member").isNotNull())
    by = rows.groupBy(F.col("cell.dimension").alias("dimension"), F.col("cell.member").alias("member"))
    return write_once(by.agg(F.sum("v").alias("revenue")))


def contribution(df: DataFrame, dims: dict[str, str | Column], ks: Sequence[int] = (1, 3, 5), amount: str = "total_amount") -> DataFrame:
    """Share of revenue of the k largest members of each dimension, for each k."""
    by = member_revenue(df, dims, amount)
    lead = first_per_group(by, ["dimension"], [F.col("revenue").desc(), F.col("member")], max(ks))
    lead = lead.groupBy("dimension").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("revenue"))).alias(f"top{k}") for k in ks])
    whole = by.groupBy("dimension").agg(F.sum("revenue").alias("total_revenue"))
    return whole.join(lead, "dimension").select(
        "dimension", "total_revenue", *[percent(F.col(f"top{k}"), F.col("total_revenue")).alias(f"top{k}_share") for k in ks]
    )


def extremes(df: DataFrame, dims: dict[str, str | Column], amount: str = "total_amount") -> DataFrame:
    """Best, second best and lowest member of each dimension (ties: first name)."""
    by = member_revenue(df, dims, amount)
    best = first_per_group(by, ["dimension"], [F.col("revenue").desc(), F.col("member")], 2).groupBy("dimension").agg(
        F.max(F.when(F.col("rank") == 1, F.col("member"))).alias("top_member"),
        F.max(F.when(F.col("rank") == 1, F.col("revenue"))).alias("top_revenue"),
        F.max(F.when(F.col("rank") == 2, F.col("member"))).alias("second_member"),
    )
    least = by.groupBy("dimension").agg(
        F.min_by("member", F.struct("revenue", "member")).alias("lowest_member"), F.min("revenue").alias("lowest_revenue")
    )
    return best.join(least, "dimension")


def daily_trend_direction(df: DataFrame, **cols) -> DataFrame:
    """Direction by the mean change from one selling day to the next."""
    mean = F.avg("growth")
    return growth_table(df, "day", **cols).agg(
        mean.alias("mean_change"), F.when(mean > 0, "increasing").otherwise("declining").alias("direction")
    )


def first_last_direction(df: DataFrame, period: str = "month", **cols) -> DataFrame:
    """Compare the first and the last period that have sales."""
    first, last = F.min_by("revenue", "period_start"), F.max_by("revenue", "period_start")
    return (
        revenue_by_period(df, period, **cols)
        .agg(
            F.min_by("period", "period_start").alias("first_period"),
            F.max_by("period", "period_start").alias("last_period"),
            first.alias("first_revenue"),
            last.alias("last_revenue"),
            long_count().alias("periods"),
        )
        .withColumn(
            "direction",
            F.when(F.col("periods") < 2, "stable")
            .when(F.col("last_revenue") > F.col("first_revenue"), "upward")
            .when(F.col("last_revenue") < F.col("first_revenue"), "downward")
            .otherwise("stable"),
        )
    )


def monthly_alert(df: DataFrame, threshold: float = 20.0, **cols) -> DataFrame:
    """Last month against the month before: spike, drop or normal."""
    change = F.col("growth") * 100.0
    return (
        growth_table(df, "month", **cols)
        .orderBy(F.col("period_start").desc())
        .limit(1)
        .select(
            "period",
            "revenue",
            change.alias("change_pct"),
            F.when(change > threshold, "spike").when(change < -threshold, "drop").otherwise("normal").alias("alert"),
        )
    )


def month_year_matrix(df: DataFrame, amount: str = "total_amount", date: str = "date") -> DataFrame:
    """Long form of the month by year matrix, so that no year has to be known beforehand."""
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.month(date).cast("bigint").alias("month"), F.year(date).cast("bigint").alias("year"))
        .agg(F.sum(amount).alias("revenue"))
    )


def quarter_by(df: DataFrame, dim: str, amount: str = "total_amount", date: str = "date") -> DataFrame:
    _, label = PERIODS["quarter"]
    return (
        df.where(F.col(dim).isNotNull())
        .groupBy(F.to_date(F.date_trunc("quarter", F.col(date))).alias("__q"), F.col(dim))
        .agg(F.sum(amount).alias("revenue"))
        .select(label(F.col("__q")).alias("quarter"), dim, "revenue")
    )


def region_month_matrix(df: DataFrame, region: str = "region", amount: str = "total_amount", date: str = "date") -> DataFrame:
    """Long form of the region by month matrix: every region with every month from the first to the last date, 0 where
    there is no revenue."""
    month = F.trunc(date, "month")
    sums = materialize(df.where(F.col(date).isNotNull()).groupBy(region, month.alias("m")).agg(F.sum(amount).alias("v")))
    edge = one_row(sums.agg(F.min("m").alias("first"), F.max("m").alias("last")))
    regions = sums.where(F.col(region).isNotNull()).select(region).distinct()
    span = F.sequence(F.lit(edge["first"]), F.lit(edge["last"]), F.expr("interval 1 month"))
    cells = regions.withColumn("m", F.explode(span))
    return cells.join(sums, [region, "m"], "left").select(
        region, F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("v", F.lit(0.0)).alias("revenue")
    )


def scalar_answers(df: DataFrame, metric: str) -> DataFrame:
    m = F.col(metric)
    return df.agg(
        F.sum(m).alias("total"), F.avg(m).alias("average"), F.max(m).alias("maximum"), F.min(m).alias("minimum"),
        long_count().alias("rows"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum belongs to the last bin."""
    edge = one_row(df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin bigint, bin_start double, rows bigint")
    x = F.col(column).cast("double")
    if lo == hi:
        bin_no = F.lit(1).cast("bigint")
        lo, hi = lo - 0.5, hi + 0.5
    else:
        bin_no = F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins).cast("bigint"))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(bin_no.alias("bin"))
        .agg(long_count().alias("rows"))
        .withColumn("bin_start", F.lit(lo) + (F.col("bin") - 1) * F.lit((hi - lo) / bins))
    )


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles per group and whiskers: the outermost values within 1.5 IQR of the box."""
    quart = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[by])
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        df.where(F.col(by).isNotNull() & v.isNotNull())
        .join(quart, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def text_rows(rows: Sequence[tuple[str, DataFrame, Column]]) -> DataFrame:
    """(position, kind, text) rows, each text computed from a one-row frame."""
    parts = [
        frame.select(F.lit(i).cast("bigint").alias("position"), F.lit(kind).alias("kind"), text.alias("text"))
        for i, (kind, frame, text) in enumerate(rows, 1)
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("text").isNotNull())


def money(value: Column) -> Column:
    return F.format_number(edge_round(value, 2), 2)


def dataset_insights(df: DataFrame, quality: DataFrame, amount: str = "total_amount", date: str = "date") -> DataFrame:
    """Figures of shape, quality and revenue, and the direction from the first to the last month: ``position, finding,
    value, label``. Each of the two sources is scanned once."""
    months = df.groupBy(F.date_format(date, "yyyy-MM").alias("period")).agg(F.sum(amount).alias("revenue"))
    turn = months.agg(
        F.sum("revenue").alias("revenue"),
        F.min_by("revenue", "period").alias("first"),
        F.max_by("revenue", "period").alias("last"),
        F.count("period").alias("months"),
    )
    change = F.col("last") - F.col("first")
    label = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")

    def figures(frame: DataFrame, start: int, rows: list[tuple[str, Column, Column]]) -> DataFrame:
        cells = [
            F.struct(F.lit(k).cast("bigint").alias("position"), F.lit(name).alias("finding"), value.cast("double").alias("value"), text.alias("label"))
            for k, (name, value, text) in enumerate(rows, start)
        ]
        return frame.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")

    none = F.lit(None).cast("string")
    names = ("row_count", "column_count", "quality_score", "missing_pct", "duplicate_pct")
    shape = figures(quality, 1, [(n, F.col(n), none) for n in names])
    money = figures(turn, 1 + len(names), [("revenue", F.col("revenue"), none), ("direction", change, F.when(F.col("months") >= 2, label))])
    return shape.unionByName(money).where((F.col("finding") != "direction") | F.col("label").isNotNull())


def _month_category(df: DataFrame, amount: str, category: str, date: str) -> tuple[DataFrame, DataFrame, dict]:
    """From one pass: first and last of the last twelve months, the best category, the totals."""
    by = materialize(
        df.groupBy(F.date_format(date, "yyyy-MM").alias("period"), F.col(category).alias("name")).agg(
            F.sum(amount).alias("revenue"), F.count(amount).alias("n"), long_count().alias("rows")
        )
    )
    months = by.where(F.col("period").isNotNull()).groupBy("period").agg(F.sum("revenue").alias("revenue"))
    turn = (
        months.orderBy(F.col("period").desc()).limit(12)
        .agg(
            F.min_by("revenue", "period").alias("a"), F.max_by("revenue", "period").alias("b"),
            F.min("period").alias("first"), F.max("period").alias("last"), long_count().alias("n"),
        )
    )
    names = by.where(F.col("name").isNotNull()).groupBy("name").agg(F.sum("revenue").alias("revenue"))
    best = top_n(names, [F.col("revenue").desc(), F.col("name")], 1)
    whole = one_row(
        by.agg(
            F.sum("revenue").alias("total"), ratio(F.sum("revenue"), F.sum("n")).alias("aov"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        )
    )
    return turn, best, whole


def _share_text(whole: dict) -> Column:
    return F.concat(
        money(F.col("revenue")), F.lit(" or "),
        F.format_number(edge_round(percent(F.col("revenue"), F.lit(whole["total"])), 1), 1), F.lit("% of revenue."),
    )


def executive_insights(
    df: DataFrame, quality: DataFrame, amount: str = "total_amount", category: str = "product_category", date: str = "date",
) -> DataFrame:
    """Up to six rows: quality, scale, top contributor, trend, and a risk when revenue falls."""
    turn, best, whole = _month_category(df, amount, category, date)
    moved = (
        F.when(F.col("b") > F.col("a"), "upward").when(F.col("b") < F.col("a"), "downward").otherwise("stable")
    )
    rows = [
        (
            "quality",
            quality,
            F.concat(
                F.lit("Data quality is "), F.format_number("quality_score", 2), F.lit("/100: "),
                F.format_number("missing_pct", 2), F.lit("% missing, "), F.format_number("duplicate_pct", 2), F.lit("% duplicate."),
            ),
        ),
        (
            "scale",
            quality,
            F.concat(
                F.lit("Revenue "), money(F.lit(whole["total"])), F.lit(" in "), F.format_number(F.lit(whole["rows"]), 0),
                F.lit(" orders, "), money(F.lit(whole["aov"])), F.lit(" on average."),
            ),
        ),
        ("contributor", best, F.concat(F.lit("Top contributor "), F.col("name"), F.lit(": "), _share_text(whole))),
        (
            "trend",
            turn,
            F.when(
                F.col("n") >= 2,
                F.concat(
                    F.lit("Trend "), moved, F.lit(": "), money(F.col("a")), F.lit(" in "), F.col("first"), F.lit(", "),
                    money(F.col("b")), F.lit(" in "), F.col("last"), F.lit("."),
                ),
            ).otherwise(F.lit("Trend unknown: only one period.")),
        ),
        ("risk", turn, F.when((F.col("n") >= 2) & (F.col("b") < F.col("a")), F.lit("Risk: revenue is declining."))),
    ]
    unique = first_spelling(text_rows(rows).select("position", "text"), "text", "position")
    return unique.orderBy("position").limit(6)


def growth_recommendations(
    df: DataFrame, quality: DataFrame, churn_summary: DataFrame, mapping_confidence: str = "HIGH",
    amount: str = "total_amount", category: str = "product_category", date: str = "date",
) -> DataFrame:
    """Rule rows over quality, mapping, trend, top category, order value and customers at risk."""
    turn, best, whole = _month_category(df, amount, category, date)
    rows = [
        (
            "quality",
            quality,
            F.when(
                F.col("quality_score") < 90,
                F.concat(F.lit("Clean the data first: quality score "), F.format_number("quality_score", 2), F.lit("/100.")),
            ),
        ),
        (
            "mapping",
            quality,
            F.when(F.lit(mapping_confidence != "HIGH"), F.lit("Resolve the mapping warnings first.")),
        ),
        (
            "trend",
            turn,
            F.when(F.col("b") < F.col("a"), "Investigate the revenue decline.").when(
                F.col("b") > F.col("a"), "Keep up what drives the upward trend."
            ),
        ),
        (
            "category",
            best,
            F.concat(F.lit("Focus on "), F.col("name"), F.lit(": "), _share_text(whole)),
        ),
        (
            "retention",
            churn_summary,
            F.when(
                F.col("at_risk_count") > 0,
                F.concat(F.lit("Run a retention campaign for "), F.col("at_risk_count").cast("string"), F.lit(" customers at risk.")),
            ),
        ),
        (
            "order_value",
            best,
            F.concat(F.lit("Lift the average order value above "), money(F.lit(whole["aov"])), F.lit(".")),
        ),
    ]
    return first_spelling(text_rows(rows).select("position", "text"), "text", "position")
