"""Geography, product, promotion and basket modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edge import long_count, percent, ratio, zero_if_null
from ..session import materialize, write_once
from .clean import clean_regions
from .scale import column_quantiles, exact_quantiles, global_rank, one_row, top_n

# Texts read as "this row was on promotion".
PROMO_WORDS = ("true", "t", "yes", "y", "1", "promo", "promotion")


# ---- geography ----


def geography(df: DataFrame, region: str = "region", amount: str = "total_amount", customer: str | None = "customer_id") -> DataFrame:
    """Per region: revenue figures, customers, share, growth score, tier and rank."""
    rows = clean_regions(df, region, amount)
    people = F.count_distinct(customer) if customer and customer in df.columns else F.lit(0).cast("bigint")
    a = F.col(amount)
    base = materialize(
        rows.groupBy(F.col(region).alias("region")).agg(
            F.sum(a).alias("total_revenue"),
            F.count(a).alias("transaction_count"),
            F.avg(a).alias("avg_transaction_value"),
            F.min(a).alias("min_transaction"),
            F.max(a).alias("max_transaction"),
            F.stddev_samp(a).alias("std_dev"),
            people.alias("unique_customers"),
        )
    )
    peak = one_row(
        base.agg(
            F.sum("total_revenue").alias("total"), F.max("transaction_count").alias("n"), F.max("unique_customers").alias("c")
        )
    )
    cut = one_row(exact_quantiles(base, "total_revenue", {"q50": 0.5, "q75": 0.75}))
    revenue = F.col("total_revenue")
    if peak["c"]:
        growth = F.col("transaction_count") / F.lit(peak["n"]) * 50 + F.col("unique_customers") / F.lit(peak["c"]) * 50
    else:
        growth = F.col("transaction_count").cast("double")
    scored = base.select(
        "*",
        zero_if_null(percent(revenue, F.lit(peak["total"]))).alias("market_share_pct"),
        zero_if_null(ratio(revenue, F.col("unique_customers"))).alias("revenue_per_customer"),
        growth.alias("growth_score"),
        F.when(revenue >= F.lit(cut["q75"]), "Tier 1 (Top Performer)")
        .when(revenue >= F.lit(cut["q50"]), "Tier 2 (Strong)")
        .otherwise("Tier 3 (Growth Opportunity)")
        .alias("performance_tier"),
    )
    return global_rank(scored, [revenue.desc(), F.col("region")])


def geography_summary(df: DataFrame, emerging_above: float = 30.0, **cols) -> DataFrame:
    table = geography(df, **cols)
    promising = F.when(F.col("growth_score") > emerging_above, F.struct("total_revenue", "region"))
    return table.agg(
        long_count().alias("total_regions"),
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("transaction_count").alias("total_transactions"),
        F.sum("unique_customers").alias("total_customers"),
        F.avg("total_revenue").alias("avg_region_revenue"),
        F.min_by("region", "rank").alias("highest_performing"),
        F.min(promising).getField("region").alias("emerging_market"),
        F.count_if(F.col("performance_tier").startswith("Tier 1")).alias("tier_1_regions"),
    )


# ---- products ----


def product_performance(df: DataFrame, **cols) -> DataFrame:
    """Per product: sales figures, share, growth score, quadrant by the upper quartiles, rank."""
    return global_rank(_product_rows(df, **cols), [F.col("total_sales").desc(), F.col("product")])


def _product_rows(df: DataFrame, product: str = "product", amount: str = "total_amount") -> DataFrame:
    a = F.col(amount)
    base = write_once(
        df.where(F.col(product).isNotNull())
        .groupBy(F.col(product).alias("product"))
        .agg(
            zero_if_null(F.sum(a)).alias("total_sales"),
            F.avg(a).alias("avg_order_value"),
            F.count(a).alias("transaction_count"),
            F.min(a).alias("min_amount"),
            F.max(a).alias("max_amount"),
            F.stddev_samp(a).alias("std_dev"),
        )
    )
    whole = one_row(base.agg(F.sum("total_sales").alias("t")))["t"]
    cut = one_row(column_quantiles(base, {"total_sales": {"volume": 0.75}, "avg_order_value": {"value": 0.75}}))
    busy, dear = F.col("total_sales") > F.lit(cut["volume"]), F.col("avg_order_value") > F.lit(cut["value"])
    return base.select(
        "*",
        zero_if_null(percent(F.col("total_sales"), F.lit(whole))).alias("market_share_pct"),
        (F.col("transaction_count") * F.col("avg_order_value") / 100).alias("growth_score"),
        F.when(busy & dear, "Star").when(busy, "Workhorse").when(dear, "Premium").otherwise("Standard").alias("quadrant"),
    )


def product_summary(df: DataFrame, **cols) -> DataFrame:
    """Totals, the best product and the size of every quadrant."""
    return _product_rows(df, **cols).agg(
        long_count().alias("total_products"),
        F.sum("total_sales").alias("total_revenue"),
        F.avg("total_sales").alias("avg_product_revenue"),
        F.min_by("product", F.struct(-F.col("total_sales"), F.col("product"))).alias("top_product"),
        F.max("total_sales").alias("top_product_revenue"),
        *[F.count_if(F.col("quadrant") == q).alias(f"{q.lower()}_products") for q in ("Star", "Workhorse", "Premium", "Standard")],
    )


def products_in(df: DataFrame, quadrant: str, **cols) -> DataFrame:
    """The products of one quadrant. Those of large volume come before all others, so only one of the two halves is ranked."""
    rows, busy = _product_rows(df, **cols), F.col("quadrant").isin("Star", "Workhorse")
    large = quadrant in ("Star", "Workhorse")
    before = 0 if large else rows.where(busy).count()
    ranked = global_rank(rows.where(busy if large else ~busy), [F.col("total_sales").desc(), F.col("product")])
    return ranked.withColumn("rank", F.col("rank") + F.lit(before)).where(F.col("quadrant") == quadrant)


def performance_score(df: DataFrame, dim: str, amount: str = "total_amount") -> DataFrame:
    """Revenue tier (33 % / 66 %) and a weighted score of revenue, orders and mean value, each scaled to 0..1."""
    base = write_once(
        df.where(F.col(dim).isNotNull())
        .groupBy(F.col(dim).alias("member"))
        .agg(F.sum(amount).alias("revenue"), F.count(amount).alias("orders"), F.avg(amount).alias("average_value"))
    )
    cut = one_row(exact_quantiles(base, "revenue", {"q33": 0.33, "q66": 0.66}))
    names = ("revenue", "orders", "average_value")
    span = one_row(base.agg(*[f(c).cast("double").alias(p + c) for c in names for f, p in ((F.min, "lo_"), (F.max, "hi_"))]))

    def scaled(c: str) -> Column:
        width = (span["hi_" + c] or 0.0) - (span["lo_" + c] or 0.0)
        return (F.col(c) - F.lit(span["lo_" + c])) / F.lit(width) if width else F.lit(0.0)

    score = scaled("revenue") * 0.5 + scaled("orders") * 0.3 + scaled("average_value") * 0.2
    r = F.col("revenue")
    return base.select(
        "*",
        F.when(r >= F.lit(cut["q66"]), "high").when(r >= F.lit(cut["q33"]), "medium").otherwise("low").alias("tier"),
        score.alias("score"),
        F.when(score >= 0.66, "star").when(score >= 0.33, "stable").otherwise("weak").alias("standing"),
    )


# ---- promotions ----


def promo_flag(df: DataFrame, promo: str | None = None, amount: str = "total_amount") -> Column:
    """Promotion column if there is one; otherwise amounts below the lower quartile."""
    if promo is None:
        limit = one_row(exact_quantiles(df, amount, {"q": 0.25}))["q"]
        return F.coalesce(F.col(amount) < F.lit(limit), F.lit(False))
    kind = df.schema[promo].dataType
    c = F.col(promo)
    if isinstance(kind, T.BooleanType):
        flag = c
    elif isinstance(kind, T.NumericType):
        flag = c > 0
    else:
        flag = F.lower(F.trim(c.cast("string"))).isin(*PROMO_WORDS)
    return F.coalesce(flag, F.lit(False))


def promo_impact(df: DataFrame, promo: str | None = None, amount: str = "total_amount") -> DataFrame:
    """Promoted against other rows: counts, means, revenue, lift and a recommendation."""
    flagged = df.select(promo_flag(df, promo, amount).alias("p"), F.col(amount).alias("a"))
    p, a = F.col("p"), F.col("a")
    both = flagged.agg(
        long_count().alias("total_transactions"),
        F.count_if(p).alias("promotional_transactions"),
        F.count_if(~p).alias("non_promotional_transactions"),
        F.avg(F.when(p, a)).alias("promo_avg_value"),
        F.avg(F.when(~p, a)).alias("non_promo_avg_value"),
        zero_if_null(F.sum(F.when(p, a))).alias("promo_total_revenue"),
        zero_if_null(F.sum(F.when(~p, a))).alias("non_promo_total_revenue"),
    )
    lift = percent(F.col("promo_avg_value") - F.col("non_promo_avg_value"), F.col("non_promo_avg_value"))
    revenue = F.col("promo_total_revenue") + F.col("non_promo_total_revenue")
    return both.select(
        "*",
        percent(F.col("promotional_transactions"), F.col("total_transactions")).alias("promotion_rate"),
        lift.alias("avg_order_lift"),
        percent(F.col("promo_total_revenue"), revenue).alias("promo_revenue_percentage"),
    ).select(
        "*",
        F.when(F.col("avg_order_lift") > 0, "Positive").when(F.col("avg_order_lift").isNotNull(), "Negative").alias("effectiveness_rating"),
        F.when(F.col("avg_order_lift") > 5, "Expand promos")
        .when(F.col("avg_order_lift") > -5, "Maintain current level")
        .when(F.col("avg_order_lift").isNotNull(), "Reduce promos")
        .alias("recommendation"),
    )


# ---- baskets ----

#: Items of one range of ``pair_counts``.
RANGE_ITEMS = 256


def basket_items(df: DataFrame, item: str, basket: str) -> DataFrame:
    """Distinct (basket, item); made once, since three steps read it."""
    rows = df.where(F.col(basket).isNotNull())
    return write_once(rows.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct())


def frequent_items(baskets: DataFrame, min_support: float = 0.02) -> tuple[DataFrame, int]:
    """Items found in at least ``min_support`` of the baskets, and the number of baskets."""
    if min_support <= 0:
        raise ValueError("min_support must be positive: it bounds the number of items kept")
    total = one_row(baskets.agg(F.count_distinct("basket").alias("n")))["n"]
    counted = (
        baskets.where(F.col("item").isNotNull())
        .groupBy("item")
        .agg(long_count().alias("frequency"))
        .withColumn("support", F.col("frequency") / F.lit(float(max(total, 1))))
        .where(F.col("support") >= min_support)
    )
    return materialize(counted), total


def pair_counts(baskets: DataFrame, items: DataFrame, width: int = RANGE_ITEMS) -> DataFrame:
    """In how many baskets two frequent items meet (a < b).

    Items are dealt into ranges of about ``width`` by a hash. A basket becomes one short set per range it touches, and one
    row per pair of such ranges; equal rows are counted once. Rows of a pair of ranges are brought together (of few ranges into several
    parts each), so a task counts few different pairs at a time and no row is longer than two sets, however large a
    basket is. Pairs are summed before they are shuffled again.
    """
    ranges = max(1, -(-items.count() // width))
    parts = max(1, int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.select("item", F.pmod(F.xxhash64("item"), F.lit(ranges)).cast("int").alias("r"))
    sets = baskets.join(dealt, "item").repartition("basket").groupBy("basket", "r").agg(F.sort_array(F.collect_set("item")).alias("set"))
    if ranges > 1:
        other = sets.select(F.col("basket").alias("__basket"), F.col("r").alias("s"), F.col("set").alias("other"))
        met = sets.join(other, (F.col("basket") == F.col("__basket")) & (F.col("r") <= F.col("s")))
    else:
        met = sets.withColumns({"s": F.col("r"), "other": F.col("set")})
    spread = max(1, 2 * parts // (ranges * (ranges + 1)))
    met = met.where((F.col("r") < F.col("s")) | (F.size("set") >= 2)).withColumn("part", F.pmod(F.xxhash64("set", "other"), F.lit(spread)))
    rows = met.repartition("r", "s", "part").groupBy("r", "s", "part", "set", "other").agg(long_count().alias("baskets"))
    first = rows.select("baskets", "r", "s", "other", F.posexplode("set").alias("i", "x"))
    behind = F.when(F.col("r") == F.col("s"), F.slice("other", F.col("i") + 2, F.size("other"))).otherwise(F.col("other"))
    pairs = first.select("baskets", "x", F.explode(behind).alias("y"))
    return (
        pairs.groupBy(F.least("x", "y").alias("product_a"), F.greatest("x", "y").alias("product_b"))
        .agg(F.sum("baskets").alias("co_purchase_count"))
    )


def all_rules(
    df: DataFrame, item: str = "product_category", basket: str = "transaction_id",
    min_support: float = 0.02, min_confidence: float = 0.3,
) -> tuple[DataFrame, DataFrame, int]:
    baskets = basket_items(df, item, basket)
    items, total = frequent_items(baskets, min_support)
    a = items.select(F.col("item").alias("product_a"), F.col("frequency").alias("__fa"), F.col("support").alias("__sa"))
    b = items.select(F.col("item").alias("product_b"), F.col("support").alias("__sb"))
    support = F.col("co_purchase_count") / F.lit(float(max(total, 1)))
    rules = (
        pair_counts(baskets, items)
        .join(a, "product_a")
        .join(b, "product_b")
        .select(
            "product_a", "product_b", "co_purchase_count",
            support.alias("support"),
            (F.col("co_purchase_count") / F.col("__fa")).alias("confidence"),
            (support / (F.col("__sa") * F.col("__sb"))).alias("lift"),
        )
        .where((F.col("confidence") >= min_confidence) & (F.col("lift") > 1))
        .withColumn("strength", F.when(F.col("lift") > 3, "Very Strong").when(F.col("lift") > 2, "Strong").otherwise("Moderate"))
    )
    return rules, items, total


def _rule_order() -> list[Column]:
    return [F.col("lift").desc(), F.col("product_a"), F.col("product_b")]


def affinity_rules(df: DataFrame, n: int = 50, **options) -> DataFrame:
    return top_n(all_rules(df, **options)[0], _rule_order(), n)


def affinity_recommendations(df: DataFrame, n: int = 10, **options) -> DataFrame:
    return affinity_rules(df, n, **options).select(
        "rank",
        F.col("product_a").alias("when_bought"),
        F.col("product_b").alias("also_recommend"),
        F.concat(F.format_number(F.col("confidence") * 100, 1), F.lit("%")).alias("likelihood"),
        "strength",
        "co_purchase_count",
        F.concat(F.format_number("lift", 2), F.lit("x")).alias("lift_multiplier"),
    )


def affinity_matrix(df: DataFrame, n: int = 50, **options) -> DataFrame:
    """Every frequent item with the items its rules (of the best n) point to."""
    rules, items, _ = all_rules(df, **options)
    related = (
        top_n(rules, _rule_order(), n)
        .groupBy("product_a")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("product_b").alias("product"), "confidence", "lift"))).alias("related"))
    )
    joined = items.join(related, F.col("item") == F.col("product_a"), "left")
    empty = F.array().cast(related.schema["related"].dataType)
    return joined.select("item", "support", "frequency", F.coalesce("related", empty).alias("related"))


def affinity_summary(df: DataFrame, **options) -> DataFrame:
    rules, items, total = all_rules(df, **options)
    rules = materialize(rules)
    products = items.count()
    pair = F.concat("product_a", F.lit(" & "), "product_b")
    best = F.struct(-F.col("lift"), F.col("product_a"), F.col("product_b"))
    return rules.agg(
        F.lit(products).cast("bigint").alias("total_products"),
        long_count().alias("total_rules"),
        F.min_by(pair, best).alias("top_product_pair"),
        zero_if_null(F.max("confidence")).alias("highest_confidence"),
        zero_if_null(F.max("lift")).alias("highest_lift"),
        zero_if_null(F.avg("confidence")).alias("average_confidence"),
        zero_if_null(F.avg("lift")).alias("average_lift"),
        F.lit(total).cast("bigint").alias("total_transactions"),
        F.count_if(F.col("strength").isin("Strong", "Very Strong")).alias("opportunities_count"),
    )
