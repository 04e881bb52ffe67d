"""Customer modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import customers, kpi
from ..facts import orders_fact, sales
from .kpis import BASE_SQL, CHURN_SQL, KPI_SQL
from .registry import R, query, tidy, with_orders, with_sales

FACT = ["customer_id", "date", "total_amount"]
BASE = BASE_SQL.format(fact="orders_fact")


def _fact(spark, folder):
    return orders_fact(spark, folder, FACT)


@query(
    with_orders(
        f"""SELECT tier, n AS customers, {R('v')} AS revenue,
        CASE WHEN tier = 'Total' THEN 100.0 ELSE {R('100.0 * n / (SELECT count(*) FROM base)', 1)} END AS percent FROM
        (SELECT CASE WHEN monetary >= q66 THEN 'Premium' WHEN monetary >= q33 THEN 'Standard' ELSE 'Basic' END AS tier, count(*) AS n, sum(monetary) AS v
           FROM base, (SELECT quantile_cont(monetary, 0.33) AS q33, quantile_cont(monetary, 0.66) AS q66 FROM base) GROUP BY 1
         UNION ALL SELECT 'Total', count(*), sum(monetary) FROM base)""",
        BASE,
    )
)
def spend_tiers(spark, folder):
    return tidy(kpi.spend_tiers(_fact(spark, folder)), percent=1)


RFM_SQL = """rfm AS (SELECT customer_id, datediff('day', last_p, (SELECT max(last_p) FROM base)) + 1 AS recency, n AS frequency, monetary FROM base)"""


@query(with_orders(f"SELECT customer_id, recency, frequency, {R('monetary')} AS monetary FROM rfm", BASE, RFM_SQL))
def rfm(spark, folder):
    return tidy(customers.rfm(_fact(spark, folder)))


CUTS_SQL = """cuts AS (SELECT quantile_cont(recency, 0.66) AS r66, quantile_cont(frequency, 0.33) AS f33, quantile_cont(frequency, 0.66) AS f66,
  quantile_cont(monetary, 0.33) AS m33, quantile_cont(monetary, 0.66) AS m66 FROM rfm)"""
SEGMENT_RULES = {
    "loyal": "frequency >= f66 AND monetary >= m66",
    "regular": "(frequency >= f33 AND frequency < f66) OR (monetary >= m33 AND monetary < m66)",
    "at-risk": "recency >= r66 OR frequency <= f33",
}


def _register_segment(short: str) -> None:
    members = f"members AS (SELECT customer_id FROM rfm, cuts WHERE {SEGMENT_RULES[short]})"

    @query(
        with_orders(KPI_SQL + " FROM orders_fact WHERE customer_id IN (SELECT customer_id FROM members)", BASE, RFM_SQL, CUTS_SQL, members),
        name="segment_" + short.replace("-", "_"),
    )
    def run(spark, folder):
        return tidy(kpi.business_kpis(customers.segment_rows(_fact(spark, folder), f"{short} customers")))


for _short in SEGMENT_RULES:
    _register_segment(_short)


@query(with_orders("SELECT customer_id FROM rfm, cuts WHERE " + SEGMENT_RULES["loyal"], BASE, RFM_SQL, CUTS_SQL))
def segment_loyal_members(spark, folder):
    return customers.segment_members(_fact(spark, folder), "Loyal Customers")


# ---- lifetime value ----

CLV_SQL = """clv AS (SELECT customer_id, monetary AS clv, frequency AS purchase_count, aov, lo, hi, first_p, last_p,
    datediff('day', first_p, last_p) AS lifetime_days,
    coalesce(datediff('day', first_p, last_p) / nullif(frequency - 1, 0), 0) AS gap,
    100 * monetary / (SELECT sum(monetary) FROM base) AS pct,
    CASE WHEN monetary >= q75 THEN 'high' WHEN monetary >= q25 THEN 'medium' ELSE 'low' END AS tier,
    row_number() OVER (ORDER BY monetary DESC, customer_id) AS rank
  FROM base, (SELECT quantile_cont(monetary, 0.25) AS q25, quantile_cont(monetary, 0.75) AS q75 FROM base))"""
CLV_COLUMNS = f"""SELECT customer_id, {R('clv')} AS clv, purchase_count, {R('aov')} AS avg_order_value, {R('lo')} AS min_order_value,
  {R('hi')} AS max_order_value, first_p AS first_purchase, last_p AS last_purchase, lifetime_days, {R('gap')} AS purchase_gap_days,
  {R('pct', 4)} AS clv_percent, tier, rank FROM clv"""


@query(with_orders(CLV_COLUMNS, BASE, CLV_SQL))
def clv(spark, folder):
    return tidy(customers.lifetime_value(_fact(spark, folder)), clv_percent=4)


@query(with_orders(CLV_COLUMNS + " WHERE rank <= 25", BASE, CLV_SQL))
def clv_top(spark, folder):
    return tidy(customers.lifetime_top(_fact(spark, folder), 25), clv_percent=4)


@query(with_orders(CLV_COLUMNS + " WHERE tier = 'high'", BASE, CLV_SQL))
def clv_tiers(spark, folder):
    return tidy(customers.lifetime_tier(_fact(spark, folder), "high"), clv_percent=4)


@query(
    with_orders(
        f"""SELECT count(*) AS total_customers, {R('sum(clv)')} AS total_clv, {R('avg(clv)')} AS average_clv,
        {R('quantile_cont(clv, 0.5)')} AS median_clv, {R('max(clv)')} AS max_clv, {R('min(clv)')} AS min_clv,
        {R('stddev_samp(clv)')} AS std_clv, min(k) AS top_20_pct_count, {R('sum(clv) FILTER (rank <= k)')} AS top_20_pct_revenue,
        {R('100 * sum(clv) FILTER (rank <= k) / sum(clv)', 4)} AS top_20_pct_contribution,
        count(*) FILTER (tier = 'high') AS high_value, count(*) FILTER (tier = 'medium') AS medium_value,
        count(*) FILTER (tier = 'low') AS low_value
        FROM clv, (SELECT greatest(1, CAST(floor(count(*) * 0.2) AS BIGINT)) AS k FROM base)""",
        BASE,
        CLV_SQL,
    )
)
def clv_summary(spark, folder):
    return tidy(customers.lifetime_summary(_fact(spark, folder)), top_20_pct_contribution=4)


# ---- repeat purchase ----

GAPS_SQL = """steps AS (SELECT customer_id, date, datediff('day', lag(date) OVER (PARTITION BY customer_id ORDER BY date), date) AS gap FROM orders_fact),
gaps AS (SELECT customer_id, count(*) AS n, avg(gap) AS mean_gap, min(gap) AS min_gap, max(gap) AS max_gap FROM steps GROUP BY 1)"""


@query(
    with_orders(
        f"""SELECT customer_id, n AS purchase_count, {R('mean_gap', 4)} AS avg_gap_days, min_gap AS min_gap_days, max_gap AS max_gap_days FROM gaps""",
        GAPS_SQL,
    )
)
def repeat_gaps(spark, folder):
    return tidy(customers.purchase_gaps(_fact(spark, folder)), 4)


@query(
    with_orders(
        f"""SELECT count(*) AS total_customers, count(*) FILTER (n > 1) AS repeat_customers, count(*) FILTER (n = 1) AS one_time_customers,
        {R('100.0 * count(*) FILTER (n > 1) / count(*)')} AS repeat_rate_percent, {R('avg(n)')} AS avg_purchases_per_customer,
        CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_purchases, max(n) AS max_purchases,
        {R('coalesce(avg(mean_gap) FILTER (n > 1), 0)')} AS avg_days_between_purchase,
        count(*) FILTER (n = 2) AS two_purchases, count(*) FILTER (n BETWEEN 3 AND 5) AS three_to_five_purchases,
        count(*) FILTER (n BETWEEN 6 AND 10) AS six_to_ten_purchases, count(*) FILTER (n > 10) AS over_ten_purchases FROM gaps""",
        GAPS_SQL,
    )
)
def repeat_purchase_summary(spark, folder):
    return tidy(customers.repeat_summary(_fact(spark, folder)))


@query(
    with_orders(
        f"""SELECT row_number() OVER (ORDER BY n DESC, customer_id) AS rank, customer_id, n AS purchase_count,
        {R('coalesce(mean_gap, 0)', 4)} AS avg_gap_days FROM gaps ORDER BY n DESC, customer_id LIMIT 10""",
        GAPS_SQL,
    )
)
def top_repeat_customers(spark, folder):
    return tidy(customers.top_repeat_customers(_fact(spark, folder)), 4)


# ---- churn and health ----

LEVEL = """CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium'
  WHEN score >= 20 THEN 'Low' ELSE 'Minimal' END"""
CHURN_COLUMNS = f"""SELECT customer_id, {R('score', 4)} AS churn_risk_score, recency AS recency_days, frequency, {R('monetary')} AS monetary_value,
  {R('aov')} AS avg_order_value, {R('monthly')} AS purchase_frequency_monthly, last_p AS last_purchase, age_days AS customer_age_days,
  {LEVEL} AS risk_level, CASE WHEN recency > 180 THEN 'Long inactivity period' WHEN frequency < 2 THEN 'Low purchase frequency'
  WHEN monetary < 500 THEN 'Low lifetime value' WHEN recency > 90 THEN 'Recent inactivity' ELSE 'Declining engagement' END AS reason"""


@query(with_orders(CHURN_COLUMNS + " FROM churn", BASE, CHURN_SQL))
def churn_scores(spark, folder):
    return tidy(customers.churn_scores(_fact(spark, folder)), churn_risk_score=4)


@query(
    with_orders(
        CHURN_COLUMNS + ", row_number() OVER (ORDER BY score DESC, customer_id) AS rank FROM churn WHERE score >= 40 ORDER BY score DESC, customer_id LIMIT 20",
        BASE,
        CHURN_SQL,
    )
)
def churn_at_risk(spark, folder):
    return tidy(customers.churn_at_risk(_fact(spark, folder)), churn_risk_score=4)


@query(
    with_orders(
        "SELECT count(*) AS total_customers, "
        + ", ".join(f"count(*) FILTER ({LEVEL} = '{n}') AS {n.lower()}_risk" for n in ("Critical", "High", "Medium", "Low", "Minimal"))
        + f""", {R('avg(score)')} AS avg_churn_score, count(*) FILTER (score >= 40) AS at_risk_count,
        {R('100.0 * count(*) FILTER (score >= 40) / count(*)')} AS at_risk_percentage FROM churn""",
        BASE,
        CHURN_SQL,
    )
)
def churn_summary(spark, folder):
    return tidy(customers.churn_summary(_fact(spark, folder)))


HEALTH_SQL = f"""peak AS (SELECT max(last_p) AS newest, max(frequency) AS f, max(monetary) AS m FROM base),
far AS (SELECT max(datediff('day', last_p, newest)) AS r FROM base, peak),
health AS (SELECT customer_id, {R('''(CASE WHEN r > 0 THEN 100.0 - datediff('day', last_p, newest) / r * 100 ELSE 100.0 END) * 0.3
    + frequency / f * 100 * 0.3 + monetary / m * 100 * 0.4''', 1)} AS score, datediff('day', last_p, newest) AS recency, frequency, monetary
  FROM base, peak, far)"""
STATUS = "CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Poor' END"
HEALTH_COLUMNS = f"""SELECT customer_id, {R('score', 1)} AS health_score, recency AS recency_days, frequency, {R('monetary')} AS monetary_value,
  {STATUS} AS health_status"""


@query(with_orders(HEALTH_COLUMNS + " FROM health", BASE, HEALTH_SQL))
def health_scores(spark, folder):
    return tidy(customers.health_scores(_fact(spark, folder)), health_score=1)


@query(with_orders(HEALTH_COLUMNS + f" FROM health WHERE {STATUS} = 'Fair'", BASE, HEALTH_SQL))
def health_by_status(spark, folder):
    return tidy(customers.customers_with_health(_fact(spark, folder), "Fair"), health_score=1)


@query(
    with_orders(
        f"""(SELECT *, row_number() OVER (ORDER BY health_score DESC, customer_id) AS rank, 'top' AS list FROM ({HEALTH_COLUMNS} FROM health)
          ORDER BY health_score DESC, customer_id LIMIT 10)
        UNION ALL (SELECT *, row_number() OVER (ORDER BY health_score, customer_id) AS rank, 'at_risk' AS list FROM ({HEALTH_COLUMNS} FROM health)
          ORDER BY health_score, customer_id LIMIT 10)""",
        BASE,
        HEALTH_SQL,
    )
)
def health_extremes(spark, folder):
    return tidy(customers.health_extremes(_fact(spark, folder)), health_score=1)


@query(
    with_orders(
        f"""SELECT count(*) AS total_customers, {R('avg(score)', 4)} AS avg_health_score, {R('quantile_cont(score, 0.5)')} AS median_health_score, """
        + ", ".join(f"count(*) FILTER ({STATUS} = '{s}') AS {s.lower()}_customers" for s in ("Excellent", "Good", "Fair", "Poor"))
        + " FROM health",
        BASE,
        HEALTH_SQL,
    )
)
def health_summary(spark, folder):
    return tidy(customers.health_summary(_fact(spark, folder)), avg_health_score=4)


# ---- cohorts ----

COHORT_SQL = """first_month AS (SELECT customer_id, min(year(date) * 12 + month(date) - 1) AS cohort FROM orders_fact GROUP BY 1),
cells AS (SELECT cohort, year(date) * 12 + month(date) - 1 - cohort AS k, count(DISTINCT customer_id) AS c, sum(total_amount) AS v
  FROM orders_fact JOIN first_month USING (customer_id) GROUP BY 1, 2),
cohorts AS (SELECT format('{:04d}-{:02d}', cohort // 12, cohort % 12 + 1) AS cohort_month, k, c, v,
  first(c) OVER (PARTITION BY cohort ORDER BY k) AS size FROM cells)"""


@query(
    with_orders(
        f"""SELECT cohort_month, k AS months_since, c AS customers, {R('v')} AS revenue, size AS cohort_size,
        {R('100.0 * c / size')} AS retention_rate, {R('v / c')} AS revenue_per_customer FROM cohorts""",
        COHORT_SQL,
    )
)
def cohort_table(spark, folder):
    return tidy(customers.cohort_table(_fact(spark, folder)))


@query(
    with_orders(
        f"""SELECT cohort_month, size AS cohort_size, {R('sum(v)')} AS lifetime_value, {R('sum(v) / size')} AS avg_revenue_per_customer
        FROM cohorts GROUP BY cohort_month, size""",
        COHORT_SQL,
    )
)
def cohort_metrics(spark, folder):
    return tidy(customers.cohort_metrics(_fact(spark, folder)))


@query(
    with_orders(
        f"""SELECT cohort_month, months_since, {R('coalesce(rate, 0)')} AS retention_rate FROM (SELECT DISTINCT cohort_month FROM cohorts)
        CROSS JOIN (SELECT unnest(range(0, max(k) + 1)) AS months_since FROM cohorts)
        LEFT JOIN (SELECT cohort_month, k AS months_since, max(100.0 * c / size) AS rate FROM cohorts GROUP BY 1, 2) USING (cohort_month, months_since)""",
        COHORT_SQL,
    )
)
def cohort_retention_matrix(spark, folder):
    return tidy(customers.cohort_matrix(_fact(spark, folder)))


@query(
    with_orders(
        f"""SELECT arg_max(cohort_month, ltv) AS best_cohort, {R('max(ltv)')} AS best_lifetime_value, arg_min(cohort_month, ltv) AS worst_cohort,
        {R('min(ltv)')} AS worst_lifetime_value, {R('avg(size)')} AS avg_cohort_size, {R('avg(m1)', 4)} AS avg_month_1_retention, count(*) AS total_cohorts
        FROM (SELECT cohort_month, size, sum(v) AS ltv, max(100.0 * c / size) FILTER (k = 1) AS m1 FROM cohorts GROUP BY 1, 2)""",
        COHORT_SQL,
    )
)
def cohort_insights(spark, folder):
    return tidy(customers.cohort_insights(_fact(spark, folder)), avg_month_1_retention=4)


@query(
    with_sales(
        f"""SELECT 'kpis' AS part, NULL AS name, {R('sum(total_amount)')} AS revenue FROM sales WHERE lower(segment) = 'automobile'
        UNION ALL SELECT 'trend', p, {R('v')} FROM (SELECT strftime(date, '%Y-%m') AS p, sum(total_amount) AS v FROM sales
          WHERE lower(segment) = 'automobile' GROUP BY 1 ORDER BY 1 DESC LIMIT 12)
        UNION ALL SELECT 'category', c, {R('v')} FROM (SELECT product_category AS c, sum(total_amount) AS v FROM sales
          WHERE lower(segment) = 'automobile' GROUP BY 1 ORDER BY v DESC, c LIMIT 4)"""
    )
)
def subset_report(spark, folder):
    """KPIs, trend and top categories of one market segment."""
    from ...operators.filters import same_text

    rows = same_text(sales(spark, folder, ["date", "customer_id", "total_amount", "product_category", "segment"]), "segment", "Automobile")
    parts = [
        kpi.business_kpis(rows).select(F.lit("kpis").alias("part"), F.lit(None).cast("string").alias("name"), F.col("total_revenue").alias("revenue")),
        kpi.revenue_trend(rows, "month").select(F.lit("trend").alias("part"), F.col("period").alias("name"), "revenue"),
        kpi.top_categories(rows).select(F.lit("category").alias("part"), "name", "revenue"),
    ]
    return tidy(reduce(DataFrame.unionByName, parts))
