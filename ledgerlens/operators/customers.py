"""Customer modules: RFM, lifetime value, repeat purchase, churn risk, health, cohorts.

Each starts from one aggregate per customer, materialised once, so the fact is
scanned once however many global figures (maxima, quantiles) a score needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.coerce import lit_like, month_index, month_label, whole_days
from ..functions.edge import edge_round, ladder, long_count, percent, ratio, zero_if_null
from ..session import materialize, write_once
from .filters import keep_members
from .scale import column_quantiles, exact_quantiles, global_rank, one_row, top_n

# Cut-offs and labels of the scores.
RISK_LEVELS = [(80.0, "Critical"), (60.0, "High"), (40.0, "Medium"), (20.0, "Low")]
HEALTH_LEVELS = [(80.0, "Excellent"), (60.0, "Good"), (40.0, "Fair")]
SEGMENTS = ("loyal customers", "regular customers", "at-risk customers")


def customer_base(df: DataFrame, customer: str = "customer_id", date: str = "date", amount: str = "total_amount") -> DataFrame:
    """One row per customer; computed once and kept in the shared folder."""
    base = (
        df.where(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"))
        .agg(
            long_count().alias("rows"),
            F.count(date).alias("frequency"),
            zero_if_null(F.sum(amount)).alias("monetary"),
            F.avg(amount).alias("avg_order_value"),
            F.min(amount).alias("min_order_value"),
            F.max(amount).alias("max_order_value"),
            F.min(date).alias("first_purchase"),
            F.max(date).alias("last_purchase"),
        )
    )
    return write_once(base)


def _newest(base: DataFrame) -> Column:
    kind = base.schema["last_purchase"].dataType
    return lit_like(one_row(base.agg(F.max("last_purchase").alias("d")))["d"], kind)


def rfm(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Recency counts from the day after the newest date; frequency counts rows."""
    base = base or customer_base(df)
    return base.select(
        "customer_id",
        (whole_days(_newest(base), F.col("last_purchase")) + 1).cast("bigint").alias("recency"),
        F.col("rows").alias("frequency"),
        "monetary",
    )


def segment_members(df: DataFrame, segment: str, scores: DataFrame | None = None) -> DataFrame:
    """Customer ids of the loyal, regular or at-risk segment."""
    scores = scores or rfm(df)
    r, f, m = F.col("recency"), F.col("frequency"), F.col("monetary")
    wanted = {name: {f"{name}_low": 0.33, f"{name}_high": 0.66} for name in ("recency", "frequency", "monetary")}
    cut = one_row(column_quantiles(scores, wanted))

    def between(c, name):
        return (c >= cut[f"{name}_low"]) & (c < cut[f"{name}_high"])

    rule = {
        "loyal customers": (f >= cut["frequency_high"]) & (m >= cut["monetary_high"]),
        "regular customers": between(f, "frequency") | between(m, "monetary"),
        "at-risk customers": (r >= cut["recency_high"]) | (f <= cut["frequency_low"]),
    }
    if segment.lower() not in rule:
        raise ValueError(f"unknown segment: {segment}")
    return scores.where(rule[segment.lower()]).select("customer_id")


def segment_rows(df: DataFrame, segment: str, scores: DataFrame | None = None) -> DataFrame:
    return keep_members(df, segment_members(df, segment, scores), "customer_id")


# ---- lifetime value ----


def _lifetime_cuts(base: DataFrame, summary: bool = False) -> dict:
    """Sum, size and quartiles of the customers' values; for a summary also the median and the least value of the best fifth."""
    whole = one_row(base.agg(F.sum("monetary").alias("total"), long_count().alias("n")))
    wanted = {"q25": 0.25, "q75": 0.75}
    if summary:
        whole["best"] = max(1, int(whole["n"] * 0.2))
        wanted |= {"median": 0.5, "fifth": (whole["n"] - whole["best"]) / max(1, whole["n"] - 1)}
    return whole | one_row(exact_quantiles(base, "monetary", wanted))


def _lifetime_rows(base: DataFrame, cut: dict) -> DataFrame:
    whole = cut["total"]
    days = whole_days(F.col("last_purchase"), F.col("first_purchase"))
    clv = F.col("monetary")
    return base.select(
        "customer_id",
        clv.alias("clv"),
        F.col("frequency").alias("purchase_count"),
        "avg_order_value",
        "min_order_value",
        "max_order_value",
        F.to_date("first_purchase").alias("first_purchase"),
        F.to_date("last_purchase").alias("last_purchase"),
        days.alias("lifetime_days"),
        zero_if_null(ratio(days, F.col("frequency") - 1)).alias("purchase_gap_days"),
        zero_if_null(percent(clv, F.lit(whole))).alias("clv_percent"),
        F.when(clv >= F.lit(cut["q75"]), "high").when(clv >= F.lit(cut["q25"]), "medium").otherwise("low").alias("tier"),
    )


def _best_first() -> list[Column]:
    return [F.col("clv").desc(), F.col("customer_id")]


def lifetime_value(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Full customer table with rank, share and value tier."""
    base = base or customer_base(df)
    return global_rank(_lifetime_rows(base, _lifetime_cuts(base)), _best_first())


def lifetime_top(df: DataFrame, n: int = 10) -> DataFrame:
    """The best customers (1 to 100): cut to ``n`` rows before anything is derived from them, no rank of all the others."""
    base = customer_base(df)
    n = max(1, min(n, 100))
    best = base.orderBy(F.col("monetary").desc(), F.col("customer_id")).limit(n)
    return top_n(_lifetime_rows(best, _lifetime_cuts(base)), _best_first(), n)


def lifetime_tier(df: DataFrame, tier: str) -> DataFrame:
    """The customers of one value tier; only they are ranked, behind the number of customers in the tiers above."""
    base = customer_base(df)
    cut = _lifetime_cuts(base)
    rows = _lifetime_rows(base, cut)
    above = {"high": [], "medium": ["high"], "low": ["high", "medium"]}.get(tier, [])
    before = rows.where(F.col("tier").isin(above)).count() if above else 0
    ranked = global_rank(rows.where(F.col("tier") == tier), _best_first())
    return ranked.withColumn("rank", F.col("rank") + F.lit(before))


def lifetime_summary(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Totals, spread, the best fifth and the size of the value tiers.

    The best fifth's revenue needs no rank: values above its least value, and that value as often as is left."""
    base = base or customer_base(df)
    cut = _lifetime_cuts(base, summary=True)
    best, least = cut["best"], F.lit(cut["fifth"]).cast("double")
    clv = F.col("clv")
    above = clv > least
    top = zero_if_null(F.sum(F.when(above, clv))) + (F.lit(best) - F.count_if(above)) * least
    return _lifetime_rows(base, cut).agg(
        long_count().alias("total_customers"),
        F.sum(clv).alias("total_clv"),
        F.avg(clv).alias("average_clv"),
        F.lit(cut["median"]).cast("double").alias("median_clv"),
        F.max(clv).alias("max_clv"),
        F.min(clv).alias("min_clv"),
        F.stddev_samp(clv).alias("std_clv"),
        F.lit(best).cast("bigint").alias("top_20_pct_count"),
        top.alias("top_20_pct_revenue"),
        zero_if_null(percent(top, F.sum(clv))).alias("top_20_pct_contribution"),
        F.count_if(F.col("tier") == "high").alias("high_value"),
        F.count_if(F.col("tier") == "medium").alias("medium_value"),
        F.count_if(F.col("tier") == "low").alias("low_value"),
    )


# ---- repeat purchase ----


def purchase_gaps(df: DataFrame, customer: str = "customer_id", date: str = "date") -> DataFrame:
    """Purchases per customer and the mean, shortest and longest gap in whole days.

    Rows are first reduced to one per customer and day, so the window sees at
    most the active days of a customer. Gaps inside a day are below one day and
    count as 0, as whole days do.
    """
    daily = (
        df.where(F.col(customer).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"), F.to_date(date).alias("day"))
        .agg(long_count().alias("rows"), F.count(date).alias("dated"), F.min(date).alias("first"), F.max(date).alias("last"))
    )
    before = F.lag("last").over(W.partitionBy("customer_id").orderBy("day"))
    spaced = daily.withColumn("gap", F.when(F.col("day").isNotNull(), whole_days(F.col("first"), before)))
    same_day = F.max("dated") > 1
    return (
        spaced.groupBy("customer_id")
        .agg(
            F.sum("rows").alias("purchase_count"),
            F.sum("dated").alias("__dated"),
            F.sum("gap").alias("__sum"),
            F.when(same_day, F.lit(0).cast("bigint")).otherwise(F.min("gap")).alias("min_gap_days"),
            F.when(F.sum("dated") > 1, F.coalesce(F.max("gap"), F.lit(0).cast("bigint"))).alias("max_gap_days"),
        )
        .select(
            "customer_id",
            "purchase_count",
            F.when(F.col("__dated") > 1, F.coalesce(F.col("__sum"), F.lit(0)) / (F.col("__dated") - 1)).alias("avg_gap_days"),
            "min_gap_days",
            "max_gap_days",
        )
    )


def repeat_summary(df: DataFrame) -> DataFrame:
    gaps = write_once(purchase_gaps(df))
    median = one_row(exact_quantiles(gaps, "purchase_count", {"m": 0.5}))["m"]
    n = F.col("purchase_count")
    return gaps.agg(
        long_count().alias("total_customers"),
        F.count_if(n > 1).alias("repeat_customers"),
        F.count_if(n == 1).alias("one_time_customers"),
        zero_if_null(percent(F.count_if(n > 1), long_count())).alias("repeat_rate_percent"),
        F.avg(n).alias("avg_purchases_per_customer"),
        F.lit(None if median is None else int(median)).cast("bigint").alias("median_purchases"),
        F.max(n).alias("max_purchases"),
        zero_if_null(F.avg(F.when(n > 1, F.col("avg_gap_days")))).alias("avg_days_between_purchase"),
        F.count_if(n == 2).alias("two_purchases"),
        F.count_if(n.between(3, 5)).alias("three_to_five_purchases"),
        F.count_if(n.between(6, 10)).alias("six_to_ten_purchases"),
        F.count_if(n > 10).alias("over_ten_purchases"),
    )


def top_repeat_customers(df: DataFrame, n: int = 10) -> DataFrame:
    return top_n(purchase_gaps(df), [F.col("purchase_count").desc(), F.col("customer_id")], n).select(
        "rank", "customer_id", "purchase_count", zero_if_null(F.col("avg_gap_days")).alias("avg_gap_days")
    )


# ---- churn risk ----


def churn_scores(df: DataFrame, days_threshold: int = 90, base: DataFrame | None = None) -> DataFrame:
    """Risk score 0..100 per customer: inactivity up to 50, few purchases up to 30, little spend up to 20."""
    base = base or customer_base(df)
    newest = _newest(base)
    age = whole_days(F.col("last_purchase"), F.col("first_purchase"))
    peak = one_row(base.agg(F.max("frequency").alias("f"), F.max("monetary").alias("m"), F.max(age).alias("age")))
    recency = whole_days(newest, F.col("last_purchase"))
    months = max((peak["age"] or 0) / 30, 1)

    def lacking(value: Column, top, points: float) -> Column:
        if not top or top <= 0:
            return F.lit(points)
        return F.greatest(F.lit(0.0), F.lit(points) - value / F.lit(float(top)) * F.lit(points))

    score = F.least(
        F.lit(100.0),
        F.least(F.lit(50.0), recency / F.lit(days_threshold) * 50)
        + lacking(F.col("frequency"), peak["f"], 30.0)
        + lacking(F.col("monetary"), peak["m"], 20.0),
    )
    scored = base.select(
        "customer_id",
        edge_round(score, 4).alias("churn_risk_score"),
        recency.alias("recency_days"),
        "frequency",
        F.col("monetary").alias("monetary_value"),
        "avg_order_value",
        edge_round(F.col("frequency") / F.lit(float(months)), 2).alias("purchase_frequency_monthly"),
        F.to_date("last_purchase").alias("last_purchase"),
        age.alias("customer_age_days"),
    )
    reason = (
        F.when(F.col("recency_days") > 180, "Long inactivity period")
        .when(F.col("frequency") < 2, "Low purchase frequency")
        .when(F.col("monetary_value") < 500, "Low lifetime value")
        .when(F.col("recency_days") > 90, "Recent inactivity")
        .otherwise("Declining engagement")
    )
    return scored.withColumn("risk_level", ladder(F.col("churn_risk_score"), RISK_LEVELS, "Minimal")).withColumn("reason", reason)


def churn_at_risk(df: DataFrame, n: int = 20, days_threshold: int = 90, at_least: float = 40.0) -> DataFrame:
    risky = churn_scores(df, days_threshold).where(F.col("churn_risk_score") >= at_least)
    return top_n(risky, [F.col("churn_risk_score").desc(), F.col("customer_id")], n)


def churn_summary(df: DataFrame, days_threshold: int = 90, base: DataFrame | None = None) -> DataFrame:
    scores = churn_scores(df, days_threshold, base)
    level = F.col("risk_level")
    risky = F.count_if(F.col("churn_risk_score") >= 40)
    return scores.agg(
        long_count().alias("total_customers"),
        *[F.count_if(level == name).alias(f"{name.lower()}_risk") for name in ("Critical", "High", "Medium", "Low", "Minimal")],
        F.avg("churn_risk_score").alias("avg_churn_score"),
        risky.alias("at_risk_count"),
        zero_if_null(percent(risky, long_count())).alias("at_risk_percentage"),
    )


# ---- health score ----


def health_scores(df: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """0.3 recency + 0.3 frequency + 0.4 spend, each scaled to 0..100 by its maximum."""
    base = base or customer_base(df)
    recency = whole_days(_newest(base), F.col("last_purchase"))
    peak = one_row(base.agg(F.max(recency).alias("r"), F.max("frequency").alias("f"), F.max("monetary").alias("m")))

    def scaled(value: Column, top) -> Column:
        return value / F.lit(float(top)) * 100 if top and top > 0 else F.lit(100.0)

    r_score = F.lit(100.0) - recency / F.lit(float(peak["r"])) * 100 if peak["r"] else F.lit(100.0)
    score = r_score * 0.3 + scaled(F.col("frequency"), peak["f"]) * 0.3 + scaled(F.col("monetary"), peak["m"]) * 0.4
    return base.select(
        "customer_id",
        edge_round(score, 1).alias("health_score"),
        recency.alias("recency_days"),
        "frequency",
        F.col("monetary").alias("monetary_value"),
    ).withColumn("health_status", ladder(F.col("health_score"), HEALTH_LEVELS, "Poor"))


def health_extremes(df: DataFrame, n: int = 10) -> DataFrame:
    """The best and the worst customers by health score, each ranked from its end."""
    scores = health_scores(df)
    best = top_n(scores, [F.col("health_score").desc(), F.col("customer_id")], n).withColumn("list", F.lit("top"))
    worst = top_n(scores, [F.col("health_score").asc(), F.col("customer_id")], n).withColumn("list", F.lit("at_risk"))
    return best.unionByName(worst)


def health_summary(df: DataFrame) -> DataFrame:
    scores = health_scores(df)
    median = one_row(exact_quantiles(scores, "health_score", {"m": 0.5}))["m"]
    return scores.agg(
        long_count().alias("total_customers"),
        F.avg("health_score").alias("avg_health_score"),
        F.lit(median).cast("double").alias("median_health_score"),
        *[
            F.count_if(F.col("health_status") == s).alias(f"{s.lower()}_customers")
            for s in ("Excellent", "Good", "Fair", "Poor")
        ],
    )


def customers_with_health(df: DataFrame, status: str) -> DataFrame:
    return health_scores(df).where(F.col("health_status") == status)


# ---- cohorts ----


def cohort_table(df: DataFrame, customer: str = "customer_id", date: str = "date", amount: str | None = "total_amount") -> DataFrame:
    """Per first-purchase month and months since: customers, revenue, retention, revenue per customer.

    Rows are reduced to one per customer and month before the window, so even a
    customer with a third of all rows is a handful of rows there.
    """
    revenue = F.sum(amount) if amount and amount in df.columns else long_count().cast("double")
    monthly = (
        df.where(F.col(customer).isNotNull() & F.col(date).isNotNull())
        .groupBy(F.col(customer).alias("customer_id"), month_index(F.col(date)).alias("month"))
        .agg(revenue.alias("revenue"))
    )
    first = F.min("month").over(W.partitionBy("customer_id"))
    cells = (
        monthly.withColumn("cohort", first)
        .groupBy("cohort", (F.col("month") - F.col("cohort")).cast("bigint").alias("months_since"))
        .agg(long_count().alias("customers"), zero_if_null(F.sum("revenue")).alias("revenue"))
    )
    # one row per cohort and month from here on
    size = F.first("customers").over(W.partitionBy("cohort").orderBy("months_since"))
    return cells.select(
        month_label(F.col("cohort")).alias("cohort_month"),
        "months_since",
        "customers",
        "revenue",
        size.alias("cohort_size"),
        percent(F.col("customers"), size).alias("retention_rate"),
        ratio(F.col("revenue"), F.col("customers")).alias("revenue_per_customer"),
    )


def cohort_metrics(df: DataFrame, **cols) -> DataFrame:
    """Size, lifetime value and revenue per customer of every cohort."""
    table = cohort_table(df, **cols)
    return table.groupBy("cohort_month", "cohort_size").agg(
        F.sum("revenue").alias("lifetime_value"),
        ratio(F.sum("revenue"), F.max("cohort_size")).alias("avg_revenue_per_customer"),
    )


def cohort_matrix(df: DataFrame, **cols) -> DataFrame:
    """Long form of the retention matrix: every cohort with every month up to the oldest one seen, in percent; months
    without customers are 0."""
    table = materialize(cohort_table(df, **cols).select("cohort_month", "months_since", "retention_rate"))
    oldest = one_row(table.agg(F.max("months_since").alias("h")))["h"] or 0
    kind = table.schema["months_since"].dataType
    span = F.sequence(F.lit(0).cast(kind), F.lit(int(oldest)).cast(kind))
    cells = table.select("cohort_month").distinct().withColumn("months_since", F.explode(span))
    return cells.join(table, ["cohort_month", "months_since"], "left").fillna({"retention_rate": 0.0})


def cohort_insights(df: DataFrame, **cols) -> DataFrame:
    """Best and worst cohort by lifetime value, mean size, mean retention one month on."""
    table = cohort_table(df, **cols)
    per = table.groupBy("cohort_month", "cohort_size").agg(
        F.sum("revenue").alias("ltv"),
        F.max(F.when(F.col("months_since") == 1, F.col("retention_rate"))).alias("month_1"),
    )
    return per.agg(
        F.max_by("cohort_month", F.struct("ltv", "cohort_month")).alias("best_cohort"),
        F.max("ltv").alias("best_lifetime_value"),
        F.min_by("cohort_month", F.struct("ltv", "cohort_month")).alias("worst_cohort"),
        F.min("ltv").alias("worst_lifetime_value"),
        F.avg("cohort_size").alias("avg_cohort_size"),
        F.avg("month_1").alias("avg_month_1_retention"),
        long_count().alias("total_cohorts"),
    )
