"""Geography, product, promotion and basket modules."""

from __future__ import annotations

from ...operators import products
from ..facts import sales
from .registry import R, query, tidy, with_sales


def _geo_sql(dim: str) -> str:
    return f"""geo_base AS (SELECT {dim} AS region, sum(total_amount) AS v, count(*) AS n, avg(total_amount) AS a, min(total_amount) AS lo,
    max(total_amount) AS hi, stddev_samp(total_amount) AS sd, count(DISTINCT customer_id) AS c FROM sales GROUP BY 1),
  geo AS (SELECT *, 100 * v / (SELECT sum(v) FROM geo_base) AS share, v / c AS rpc,
    n / (SELECT max(n) FROM geo_base) * 50 + c / (SELECT max(c) FROM geo_base) * 50 AS growth,
    CASE WHEN v >= (SELECT quantile_cont(v, 0.75) FROM geo_base) THEN 'Tier 1 (Top Performer)'
         WHEN v >= (SELECT quantile_cont(v, 0.5) FROM geo_base) THEN 'Tier 2 (Strong)' ELSE 'Tier 3 (Growth Opportunity)' END AS tier,
    row_number() OVER (ORDER BY v DESC, region) AS rank FROM geo_base)"""


GEO_COLUMNS = f"""SELECT region, {R('v')} AS total_revenue, n AS transaction_count, {R('a')} AS avg_transaction_value, {R('lo')} AS min_transaction,
  {R('hi')} AS max_transaction, {R('sd')} AS std_dev, c AS unique_customers, {R('share', 4)} AS market_share_pct,
  {R('rpc')} AS revenue_per_customer, {R('growth', 4)} AS growth_score, tier AS performance_tier, rank FROM geo"""


@query(with_sales(GEO_COLUMNS, _geo_sql("country")))
def geography(spark, folder):
    rows = sales(spark, folder, ["country", "customer_id", "total_amount"])
    return tidy(products.geography(rows, region="country"), market_share_pct=4, growth_score=4)


@query(
    with_sales(
        f"""SELECT count(*) AS total_regions, {R('sum(v)')} AS total_revenue, CAST(sum(n) AS BIGINT) AS total_transactions,
        CAST(sum(c) AS BIGINT) AS total_customers, {R('avg(v)')} AS avg_region_revenue, arg_min(region, rank) AS highest_performing,
        arg_min(region, v) FILTER (growth > 30) AS emerging_market, count(*) FILTER (tier LIKE 'Tier 1%') AS tier_1_regions FROM geo""",
        _geo_sql("region"),
    )
)
def geography_summary(spark, folder):
    return tidy(products.geography_summary(sales(spark, folder, ["region", "customer_id", "total_amount"])))


PRODUCT_SQL = """prod_base AS (SELECT product, sum(total_amount) AS v, avg(total_amount) AS a, count(*) AS n, min(total_amount) AS lo,
    max(total_amount) AS hi, stddev_samp(total_amount) AS sd FROM sales GROUP BY 1),
  prod AS (SELECT *, 100 * v / (SELECT sum(v) FROM prod_base) AS share, n * a / 100 AS growth,
    CASE WHEN v > qv AND a > qa THEN 'Star' WHEN v > qv THEN 'Workhorse' WHEN a > qa THEN 'Premium' ELSE 'Standard' END AS quadrant,
    row_number() OVER (ORDER BY v DESC, product) AS rank
    FROM prod_base, (SELECT quantile_cont(v, 0.75) AS qv, quantile_cont(a, 0.75) AS qa FROM prod_base))"""
PRODUCT_COLUMNS = f"""SELECT product, {R('v')} AS total_sales, {R('a')} AS avg_order_value, n AS transaction_count, {R('lo')} AS min_amount,
  {R('hi')} AS max_amount, {R('sd')} AS std_dev, {R('share', 4)} AS market_share_pct, {R('growth')} AS growth_score, quadrant, rank FROM prod"""


def _products(spark, folder):
    return sales(spark, folder, ["product", "total_amount"])


@query(with_sales(PRODUCT_COLUMNS, PRODUCT_SQL))
def product_performance(spark, folder):
    return tidy(products.product_performance(_products(spark, folder)), market_share_pct=4)


@query(with_sales(PRODUCT_COLUMNS + " WHERE quadrant = 'Standard'", PRODUCT_SQL))
def product_quadrant(spark, folder):
    return tidy(products.products_in(_products(spark, folder), "Standard"), market_share_pct=4)


@query(
    with_sales(
        f"""SELECT count(*) AS total_products, {R('sum(v)')} AS total_revenue, {R('avg(v)')} AS avg_product_revenue,
        arg_min(product, rank) AS top_product, {R('max(v)')} AS top_product_revenue, """
        + ", ".join(f"count(*) FILTER (quadrant = '{q}') AS {q.lower()}_products" for q in ("Star", "Workhorse", "Premium", "Standard"))
        + " FROM prod",
        PRODUCT_SQL,
    )
)
def product_summary(spark, folder):
    return tidy(products.product_summary(_products(spark, folder)))


def _promo_sql(flag: str) -> str:
    return with_sales(
        f"""SELECT n AS total_transactions, p AS promotional_transactions, n - p AS non_promotional_transactions, {R('pa')} AS promo_avg_value,
        {R('na')} AS non_promo_avg_value, {R('pv')} AS promo_total_revenue, {R('nv')} AS non_promo_total_revenue,
        {R('100.0 * p / n', 4)} AS promotion_rate, {R('100 * (pa - na) / na', 4)} AS avg_order_lift, {R('100 * pv / (pv + nv)', 4)} AS promo_revenue_percentage,
        CASE WHEN 100 * (pa - na) / na > 0 THEN 'Positive' ELSE 'Negative' END AS effectiveness_rating,
        CASE WHEN 100 * (pa - na) / na > 5 THEN 'Expand promos' WHEN 100 * (pa - na) / na > -5 THEN 'Maintain current level' ELSE 'Reduce promos' END AS recommendation
        FROM (SELECT count(*) AS n, count(*) FILTER (promo) AS p, avg(total_amount) FILTER (promo) AS pa, avg(total_amount) FILTER (NOT promo) AS na,
          sum(total_amount) FILTER (promo) AS pv, sum(total_amount) FILTER (NOT promo) AS nv FROM (SELECT total_amount, {flag} AS promo FROM sales))"""
    )


RATES = {"promotion_rate": 4, "avg_order_lift": 4, "promo_revenue_percentage": 4}


@query(_promo_sql("discount > 0"))
def promo_impact(spark, folder):
    return tidy(products.promo_impact(sales(spark, folder, ["discount", "total_amount"]), "discount"), **RATES)


@query(_promo_sql("total_amount < (SELECT quantile_cont(total_amount, 0.25) FROM sales)"))
def promo_impact_derived(spark, folder):
    return tidy(products.promo_impact(sales(spark, folder, ["total_amount"])), **RATES)


@query(
    with_sales(
        f"""SELECT member, {R('v')} AS revenue, n AS orders, {R('a')} AS average_value,
        CASE WHEN v >= q66 THEN 'high' WHEN v >= q33 THEN 'medium' ELSE 'low' END AS tier, {R('s', 4)} AS score,
        CASE WHEN s >= 0.66 THEN 'star' WHEN s >= 0.33 THEN 'stable' ELSE 'weak' END AS standing FROM
        (SELECT *, (v - v0) / (v1 - v0) * 0.5 + (n - n0) / (n1 - n0) * 0.3 + (a - a0) / (a1 - a0) * 0.2 AS s FROM
          (SELECT product AS member, sum(total_amount) AS v, count(*) AS n, avg(total_amount) AS a FROM sales GROUP BY 1),
          (SELECT min(v) AS v0, max(v) AS v1, min(n) AS n0, max(n) AS n1, min(a) AS a0, max(a) AS a1,
             quantile_cont(v, 0.33) AS q33, quantile_cont(v, 0.66) AS q66 FROM
             (SELECT sum(total_amount) AS v, count(*) AS n, avg(total_amount) AS a FROM sales GROUP BY product)))"""
    )
)
def performance_score_tiers(spark, folder):
    return tidy(products.performance_score(_products(spark, folder), "product"), score=4)


# ---- baskets ----


def _rules_sql(item: str, confidence: float) -> str:
    return f"""basket AS (SELECT DISTINCT transaction_id AS t, {item} AS i FROM sales),
  total AS (SELECT count(DISTINCT t) AS n FROM basket),
  items AS (SELECT i, count(*) AS f, count(*) / max(n) AS s FROM basket, total GROUP BY 1 HAVING count(*) / max(n) >= 0.02),
  pairs AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM basket x JOIN basket y ON x.t = y.t AND x.i < y.i
    WHERE x.i IN (SELECT i FROM items) AND y.i IN (SELECT i FROM items) GROUP BY 1, 2),
  scored AS (SELECT a, b, c, c / n AS support, c / ia.f AS confidence, c / n / (ia.s * ib.s) AS lift
    FROM pairs JOIN items ia ON a = ia.i JOIN items ib ON b = ib.i, total),
  rules AS (SELECT *, CASE WHEN lift > 3 THEN 'Very Strong' WHEN lift > 2 THEN 'Strong' ELSE 'Moderate' END AS strength,
    row_number() OVER (ORDER BY lift DESC, a, b) AS rank FROM scored WHERE confidence >= {confidence} AND lift > 1)"""


RULE_COLUMNS = f"""SELECT rank, a AS product_a, b AS product_b, c AS co_purchase_count, {R('support', 6)} AS support,
  {R('confidence', 6)} AS confidence, {R('lift', 6)} AS lift, strength FROM rules WHERE rank <= 50"""
BASKET = {"item": "product_category", "basket": "transaction_id"}
BRANDS = {"item": "product", "basket": "transaction_id", "min_confidence": 0.1}


@query(with_sales(RULE_COLUMNS, _rules_sql("product_category", 0.3)))
def affinity_rules(spark, folder):
    return tidy(products.affinity_rules(sales(spark, folder, list(BASKET.values())), **BASKET), 6)


@query(with_sales(RULE_COLUMNS, _rules_sql("product", 0.1)))
def affinity_rules_brands(spark, folder):
    return tidy(products.affinity_rules(sales(spark, folder, ["product", "transaction_id"]), **BRANDS), 6)


@query(
    with_sales(
        """SELECT rank, a AS when_bought, b AS also_recommend, format('{:.1f}', confidence * 100) || '%' AS likelihood, strength,
        c AS co_purchase_count, format('{:.2f}', lift) || 'x' AS lift_multiplier FROM rules WHERE rank <= 10""",
        _rules_sql("product", 0.1),
    )
)
def affinity_recommendations(spark, folder):
    return products.affinity_recommendations(sales(spark, folder, ["product", "transaction_id"]), **BRANDS)


@query(
    with_sales(
        f"""SELECT i AS item, {R('s', 6)} AS support, f AS frequency, coalesce(string_agg(b, ',' ORDER BY rank), '') AS related
        FROM items LEFT JOIN (SELECT * FROM rules WHERE rank <= 50) ON i = a GROUP BY i, s, f""",
        _rules_sql("product", 0.1),
    )
)
def affinity_matrix(spark, folder):
    from pyspark.sql import functions as F

    matrix = products.affinity_matrix(sales(spark, folder, ["product", "transaction_id"]), **BRANDS)
    return tidy(matrix.withColumn("related", F.concat_ws(",", F.col("related.product"))), 6)


@query(
    with_sales(
        f"""SELECT (SELECT count(*) FROM items) AS total_products, count(*) AS total_rules,
        arg_min(a || ' & ' || b, rank) AS top_product_pair, {R('coalesce(max(confidence), 0)', 6)} AS highest_confidence,
        {R('coalesce(max(lift), 0)', 6)} AS highest_lift, {R('coalesce(avg(confidence), 0)', 6)} AS average_confidence,
        {R('coalesce(avg(lift), 0)', 6)} AS average_lift, (SELECT n FROM total) AS total_transactions,
        count(*) FILTER (strength <> 'Moderate') AS opportunities_count FROM rules""",
        _rules_sql("product_category", 0.3),
    )
)
def affinity_summary(spark, folder):
    return tidy(products.affinity_summary(sales(spark, folder, list(BASKET.values())), **BASKET), 6)
