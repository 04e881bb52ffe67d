"""Key figures, trends, breakdowns, filters and findings."""

from __future__ import annotations


from pyspark.sql import functions as F

from ...operators import clean, customers, filters, kpi, profile
from ..analysis import run_advanced, run_basic
from ..facts import order_revenue, orders_fact, sales, table
from ..spec import run_query, top_row_insight
from .registry import R, query, tidy, with_orders, with_sales

TOP_COUNTRIES = {"intent": "ranking_query", "metric": "revenue", "aggregation": "sum", "group_by": "country", "top_n": 5}


@query(with_sales(f"SELECT country, {R('sum(total_amount)')} AS total_amount FROM sales GROUP BY 1 ORDER BY sum(total_amount) DESC, 1 LIMIT 5"))
def spec_top_countries(spark, folder):
    return tidy(run_query(order_revenue(spark, folder, ["country", "total_amount"]), TOP_COUNTRIES))


@query(
    with_sales(
        f"""SELECT product_category, {R('avg(total_amount)')} AS total_amount FROM sales
        WHERE region IN ('ASIA', 'EUROPE') AND segment = 'BUILDING'
        GROUP BY 1 ORDER BY avg(total_amount), 1 LIMIT 3"""
    )
)
def spec_bottom_categories(spark, folder):
    spec = {
        "action": "get_top_products", "metric": "sales", "aggregation": "mean", "group_by": "product_category",
        "filters": {"region": ["ASIA", "EUROPE"], "segment": "BUILDING"}, "limit": 3, "order": "asc",
    }
    return tidy(run_query(sales(spark, folder, ["product_category", "region", "segment", "total_amount"]), spec))


@query(
    with_sales(
        f"""SELECT 'total_amount' AS metric, arg_max(country, total) AS highest, {R('max(total)')} AS value
        FROM (SELECT country, sum(total_amount) AS total FROM sales GROUP BY 1)"""
    )
)
def spec_insight(spark, folder):
    ranked = run_query(order_revenue(spark, folder, ["country", "total_amount"]), TOP_COUNTRIES)
    return tidy(top_row_insight(ranked, "total_amount", "country"))


KPI_SQL = f"""SELECT {R('sum(total_amount)')} AS total_revenue, {R('avg(total_amount)')} AS average_order_value,
  count(DISTINCT customer_id) AS unique_customers, count(*) AS total_orders, min(date) AS start_date, max(date) AS end_date"""


@query(with_sales(KPI_SQL + " FROM sales"))
def kpi_snapshot(spark, folder):
    return tidy(kpi.business_kpis(sales(spark, folder, ["date", "customer_id", "total_amount"])))


@query(with_sales(KPI_SQL + " FROM sales WHERE date >= (SELECT max(date) FROM sales) - INTERVAL 90 DAY"))
def kpi_last_90_days(spark, folder):
    return tidy(kpi.business_kpis(filters.last_days(sales(spark, folder, ["date", "customer_id", "total_amount"]), 90)))


@query(
    with_sales(
        """SELECT count(DISTINCT country) AS distinct_country, count(DISTINCT product) AS distinct_product,
        count(DISTINCT customer_id) AS distinct_customer_id, count(DISTINCT transaction_id) AS distinct_transaction_id FROM sales"""
    )
)
def kpi_distinct_counts(spark, folder):
    names = ["country", "product", "customer_id", "transaction_id"]
    return kpi.distinct_counts(sales(spark, folder, names), names)


MONTHS_SQL = """months AS (SELECT CAST(date_trunc('month', date) AS DATE) AS m, sum(total_amount) AS v FROM sales GROUP BY 1),
month_spine AS (SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM months),
monthly AS (SELECT s.m, coalesce(v, 0) AS v FROM month_spine s LEFT JOIN months USING (m)),
growth AS (SELECT m, v, (v - lag(v) OVER (ORDER BY m)) / nullif(lag(v) OVER (ORDER BY m), 0) AS g FROM monthly)"""


@query(
    with_sales(
        f"""SELECT {R('sum(total_amount)')} AS total_sales, count(DISTINCT transaction_id) AS total_orders,
        {R('avg(total_amount)')} AS average_sales, {R('sum(quantity)')} AS total_quantity,
        (SELECT {R('avg(g) * 100', 4)} FROM growth) AS average_monthly_growth FROM sales""",
        MONTHS_SQL,
    )
)
def kpi_dashboard(spark, folder):
    rows = sales(spark, folder, ["date", "transaction_id", "total_amount", "quantity"])
    return tidy(kpi.dashboard_kpis(rows), average_monthly_growth=4)


@query(with_sales(f"SELECT {R('sum(total_amount) / count(DISTINCT transaction_id)')} AS average_order_value FROM sales"))
def order_value(spark, folder):
    return tidy(kpi.order_value(sales(spark, folder, ["transaction_id", "total_amount"])))


@query(
    with_sales(
        f"""SELECT {R('sum(total_amount)')} AS revenue, {R('sum(total_amount - cost)')} AS profit,
        {R('100 * sum(total_amount - cost) / nullif(sum(total_amount), 0)', 4)} AS profit_margin FROM sales"""
    )
)
def profit_margin(spark, folder):
    rows = sales(spark, folder, ["total_amount", "cost"]).withColumnRenamed("total_amount", "revenue")
    return tidy(kpi.profit_margin(clean.add_profit(rows)), profit_margin=4)


@query(with_sales(f"SELECT {R('avg(g) * 100', 4)} AS mom_growth FROM growth", MONTHS_SQL))
def mom_growth(spark, folder):
    return tidy(kpi.mean_growth(order_revenue(spark, folder, ["date", "total_amount"]), "month", "mom_growth"), 4)


YEARS_SQL = """years AS (SELECT CAST(date_trunc('year', date) AS DATE) AS y, sum(total_amount) AS v FROM sales GROUP BY 1),
yearly AS (SELECT y, v, (v - lag(v) OVER (ORDER BY y)) / nullif(lag(v) OVER (ORDER BY y), 0) AS g FROM years)"""


@query(with_sales(f"SELECT {R('avg(g) * 100', 4)} AS yoy_growth FROM yearly", YEARS_SQL))
def yoy_growth(spark, folder):
    return tidy(kpi.mean_growth(order_revenue(spark, folder, ["date", "total_amount"]), "year", "yoy_growth"), 4)


@query(with_sales(f"SELECT strftime(y, '%Y') AS period, {R('v')} AS revenue, {R('g * 100', 4)} AS growth_pct FROM yearly", YEARS_SQL))
def yoy_table(spark, folder):
    by = kpi.growth_table(order_revenue(spark, folder, ["date", "total_amount"]), "year")
    return tidy(by.select("period", "revenue", (F.col("growth") * 100).alias("growth_pct")), growth_pct=4)


def _period_sql(unit: str, label: str) -> str:
    return with_sales(
        f"""SELECT CAST(date_trunc('{unit}', date) AS DATE) AS period_start, {label} AS period,
        {R('sum(total_amount)')} AS revenue FROM sales GROUP BY 1, 2"""
    )


PERIOD_LABELS = {
    "day": "strftime(date, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', date), '%Y-%m-%d')",
    "month": "strftime(date, '%Y-%m')",
    "quarter": "CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR)",
}


def _register_period(unit: str) -> None:
    @query(_period_sql(unit, PERIOD_LABELS[unit]), name=f"revenue_by_{unit}")
    def run(spark, folder):
        return tidy(kpi.revenue_by_period(order_revenue(spark, folder, ["date", "total_amount"]), unit))


for _unit in PERIOD_LABELS:
    _register_period(_unit)


@query(_period_sql("month", PERIOD_LABELS["month"]) + " ORDER BY 1 DESC LIMIT 12")
def last_12_periods(spark, folder):
    return tidy(kpi.revenue_trend(order_revenue(spark, folder, ["date", "total_amount"]), "month"))


@query(
    with_sales(
        f"""SELECT CAST(date_trunc('quarter', date) AS DATE) AS period_start, {PERIOD_LABELS['quarter']} AS period,
        {R('sum(total_amount - cost)')} AS revenue FROM sales GROUP BY 1, 2"""
    )
)
def profit_by_quarter(spark, folder):
    rows = sales(spark, folder, ["date", "total_amount", "cost"]).withColumn("profit", F.col("total_amount") - F.col("cost"))
    return tidy(kpi.revenue_by_period(rows, "quarter", amount="profit"))


@query(
    with_sales(
        f"""SELECT CAST(date_trunc('month', date) AS DATE) AS period_start, strftime(date, '%Y-%m') AS period,
        {R('sum(total_amount - cost)')} AS revenue FROM sales GROUP BY 1, 2"""
    )
)
def profit_by_month(spark, folder):
    rows = sales(spark, folder, ["date", "total_amount", "cost"]).withColumn("profit", F.col("total_amount") - F.col("cost"))
    return tidy(kpi.revenue_by_period(rows, "month", amount="profit"))


def _register_dimension(dim: str) -> None:
    @query(with_sales(f"SELECT {dim} AS dimension, {R('sum(total_amount)')} AS revenue FROM sales GROUP BY 1"), name=f"revenue_by_{dim}")
    def run(spark, folder):
        fact = sales if dim == "product" else order_revenue
        return tidy(kpi.revenue_by(fact(spark, folder, [dim, "total_amount"]), dim))


for _dim in ("country", "region", "product", "segment"):
    _register_dimension(_dim)


@query(
    with_sales(
        f"""SELECT CASE WHEN size > 0 AND size <= 25 THEN '18-25' WHEN size > 25 AND size <= 35 THEN '26-35'
        WHEN size > 35 AND size <= 45 THEN '36-45' WHEN size > 45 AND size <= 200 THEN '46+' END AS dimension,
        {R('sum(total_amount)')} AS revenue FROM sales WHERE size > 0 AND size <= 200 GROUP BY 1"""
    )
)
def size_bands(spark, folder):
    return tidy(kpi.revenue_by(sales(spark, folder, ["size", "total_amount"]), clean.age_band(F.col("size"))))


@query(
    with_sales(
        f"""SELECT row_number() OVER (ORDER BY r DESC, name) AS rank, name, {R('r')} AS revenue FROM
        (SELECT product_category AS name, sum(total_amount) AS r FROM sales GROUP BY 1 ORDER BY r DESC, 1 LIMIT 4)"""
    )
)
def top_categories(spark, folder):
    return tidy(kpi.top_categories(sales(spark, folder, ["product_category", "total_amount"])))


@query(
    with_orders(
        f"""SELECT row_number() OVER (ORDER BY r DESC, customer_id) AS rank, customer_id, {R('r')} AS revenue, n AS orders, {R('a')} AS average
        FROM (SELECT customer_id, sum(total_amount) AS r, count(*) AS n, avg(total_amount) AS a FROM orders_fact GROUP BY 1 ORDER BY r DESC, 1 LIMIT 8)"""
    )
)
def top_customers(spark, folder):
    return tidy(kpi.top_customers(orders_fact(spark, folder, ["customer_id", "total_amount"]), 8))


def _register_aggregate(how: str, fn: str) -> None:
    value = "count(total_amount)" if how == "count" else R(f"{fn}(total_amount)")

    @query(with_sales(f"SELECT region, segment, {value} AS value FROM sales GROUP BY 1, 2"), name=f"groupby_{how}")
    def run(spark, folder):
        rows = sales(spark, folder, ["region", "segment", "total_amount"])
        return tidy(kpi.aggregate(rows, ["region", "segment"], "total_amount", how, "value"))


for _how, _fn in (("sum", "sum"), ("mean", "avg"), ("max", "max"), ("min", "min"), ("count", "count")):
    _register_aggregate(_how, _fn)

@query(with_sales(f"SELECT month(date) AS month, year(date) AS year, {R('sum(total_amount)')} AS revenue FROM sales GROUP BY 1, 2"))
def month_year_pivot(spark, folder):
    return tidy(kpi.month_year_matrix(order_revenue(spark, folder, ["date", "total_amount"])))


@query(
    with_sales(
        f"SELECT region, month, {R('coalesce(revenue, 0)')} AS revenue FROM (SELECT DISTINCT region FROM sales)"
        " CROSS JOIN (SELECT strftime(unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM sales)"
        " LEFT JOIN (SELECT region, strftime(date, '%Y-%m') AS month, sum(total_amount) AS revenue FROM sales GROUP BY 1, 2) USING (region, month)"
    )
)
def region_month_matrix(spark, folder):
    return tidy(kpi.region_month_matrix(order_revenue(spark, folder, ["region", "date", "total_amount"])))


@query(
    with_sales(
        f"SELECT {PERIOD_LABELS['quarter']} AS quarter, product_category, {R('sum(total_amount)')} AS revenue FROM sales GROUP BY 1, 2"
    )
)
def quarter_product(spark, folder):
    return tidy(kpi.quarter_by(sales(spark, folder, ["date", "product_category", "total_amount"]), "product_category"))


def _share_sql(dim: str) -> str:
    tops = ", ".join(R(f"100 * sum(r) FILTER (k <= {n}) / sum(r)", 4) + f" AS top{n}_share" for n in (1, 3, 5))
    return f"""SELECT '{dim}' AS dimension, {R('sum(r)')} AS total_revenue, {tops} FROM
      (SELECT r, row_number() OVER (ORDER BY r DESC, m) AS k FROM
        (SELECT {dim} AS m, sum(total_amount) AS r FROM sales GROUP BY 1))"""


@query(with_sales(" UNION ALL ".join(_share_sql(d) for d in ("country", "product", "customer_name"))))
def contribution_shares(spark, folder):
    dims = ["country", "product", "customer_name"]
    return tidy(kpi.contribution(sales(spark, folder, [*dims, "total_amount"]), {d: d for d in dims}), 4, total_revenue=2)


EXTREMES = {
    "country": "country",
    "product_category": "product_category",
    "customer_name": "customer_name",
    "month": "CAST(month(date) AS VARCHAR)",
}


def _extreme_sql(label: str, expr: str) -> str:
    return f"""SELECT '{label}' AS dimension, max(m) FILTER (k = 1) AS top_member, {R('max(r) FILTER (k = 1)')} AS top_revenue,
      max(m) FILTER (k = 2) AS second_member, max(m) FILTER (b = 1) AS lowest_member, {R('max(r) FILTER (b = 1)')} AS lowest_revenue
      FROM (SELECT m, r, row_number() OVER (ORDER BY r DESC, m) AS k, row_number() OVER (ORDER BY r, m) AS b FROM
        (SELECT {expr} AS m, sum(total_amount) AS r FROM sales GROUP BY 1))"""


@query(with_sales(" UNION ALL ".join(_extreme_sql(k, v) for k, v in EXTREMES.items())))
def arg_max_dims(spark, folder):
    fact = sales(spark, folder, ["country", "product_category", "customer_name", "date", "total_amount"])
    return tidy(kpi.extremes(fact, {k: F.month("date") if k == "month" else k for k in EXTREMES}))


@query(
    with_sales(
        f"""SELECT {R('avg(g)', 4)} AS mean_change, CASE WHEN avg(g) > 0 THEN 'increasing' ELSE 'declining' END AS direction
        FROM (SELECT (v - lag(v) OVER (ORDER BY date)) / nullif(lag(v) OVER (ORDER BY date), 0) AS g
          FROM (SELECT date, sum(total_amount) AS v FROM sales GROUP BY 1))"""
    )
)
def trend_direction(spark, folder):
    return tidy(kpi.daily_trend_direction(order_revenue(spark, folder, ["date", "total_amount"])), 4)


@query(
    with_sales(
        f"""SELECT min(p) AS first_period, max(p) AS last_period, {R('arg_min(v, p)')} AS first_revenue,
        {R('arg_max(v, p)')} AS last_revenue, count(*) AS periods,
        CASE WHEN count(*) < 2 THEN 'stable' WHEN arg_max(v, p) > arg_min(v, p) THEN 'upward'
          WHEN arg_max(v, p) < arg_min(v, p) THEN 'downward' ELSE 'stable' END AS direction
        FROM (SELECT strftime(date, '%Y-%m') AS p, sum(total_amount) AS v FROM sales GROUP BY 1)"""
    )
)
def first_last_direction(spark, folder):
    return tidy(kpi.first_last_direction(order_revenue(spark, folder, ["date", "total_amount"])))


@query(
    with_sales(
        f"""SELECT strftime(m, '%Y-%m') AS period, {R('v')} AS revenue, {R('g * 100', 4)} AS change_pct,
        CASE WHEN g * 100 > 20 THEN 'spike' WHEN g * 100 < -20 THEN 'drop' ELSE 'normal' END AS alert
        FROM growth ORDER BY m DESC LIMIT 1""",
        MONTHS_SQL,
    )
)
def monthly_alert(spark, folder):
    return tidy(kpi.monthly_alert(order_revenue(spark, folder, ["date", "total_amount"])), change_pct=4)


@query(
    with_sales(
        f"""SELECT {R('sum(total_amount)')} AS total, {R('avg(total_amount)')} AS average, {R('max(total_amount)')} AS maximum,
        {R('min(total_amount)')} AS minimum, count(*) AS "rows" FROM sales"""
    )
)
def scalar_answers(spark, folder):
    return tidy(kpi.scalar_answers(sales(spark, folder, ["total_amount"]), "total_amount"))


MONEY = "format('{{:,.2f}}', {})"


def _money(expr: str) -> str:
    return MONEY.format(R(expr))


INSIGHT_QUALITY = f"""quality AS (
  SELECT n AS row_count, dup, {R('100.0 * dup / n')} AS dup_pct
  FROM (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS dup FROM
    (SELECT count(*) AS c FROM sales GROUP BY date, customer_id, product_category, total_amount)))"""


@query(
    with_sales(
        f"""SELECT position, finding, {R('value')} AS value, label FROM (
          SELECT CAST(1 AS BIGINT) AS position, 'row_count' AS finding, CAST(row_count AS DOUBLE) AS value, NULL::VARCHAR AS label FROM quality
          UNION ALL SELECT 2, 'column_count', 4, NULL
          UNION ALL SELECT 3, 'quality_score', 100 - dup_pct, NULL FROM quality
          UNION ALL SELECT 4, 'missing_pct', 0, NULL
          UNION ALL SELECT 5, 'duplicate_pct', dup_pct, NULL FROM quality
          UNION ALL SELECT 6, 'revenue', sum(total_amount), NULL FROM sales
          UNION ALL SELECT 7, 'direction', b - a, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' ELSE 'flat' END
            FROM (SELECT arg_min(v, p) AS a, arg_max(v, p) AS b FROM
              (SELECT strftime(date, '%Y-%m') AS p, sum(total_amount) AS v FROM sales GROUP BY 1)))""",
        INSIGHT_QUALITY,
    )
)
def insight_rows(spark, folder):
    rows = sales(spark, folder, ["date", "customer_id", "product_category", "total_amount"])
    return tidy(kpi.dataset_insights(rows, profile.quality_score(rows)))


BASE_SQL = """base AS (
  SELECT customer_id, count(*) AS n, count(date) AS frequency, sum(total_amount) AS monetary, avg(total_amount) AS aov,
         min(total_amount) AS lo, max(total_amount) AS hi, min(date) AS first_p, max(date) AS last_p
  FROM {fact} GROUP BY 1)"""
CHURN_SQL = f"""peak AS (SELECT max(last_p) AS newest, max(frequency) AS f, max(monetary) AS m,
    max(datediff('day', first_p, last_p)) AS age FROM base),
churn AS (SELECT customer_id, {R('''least(100.0, least(50.0, datediff('day', last_p, newest) / 90 * 50)
    + greatest(0.0, 30.0 - frequency / f * 30.0) + greatest(0.0, 20.0 - monetary / m * 20.0))''', 4)} AS score,
    datediff('day', last_p, newest) AS recency, frequency, monetary, aov, last_p,
    {R('frequency / greatest(age / 30, 1)')} AS monthly, datediff('day', first_p, last_p) AS age_days
  FROM base, peak)"""


@query(
    with_sales(
        f"""SELECT CAST(1 AS BIGINT) AS position, 'Clean the data first: quality score ' || format('{{:,.2f}}', 100 - dup_pct) || '/100.' AS text
          FROM quality WHERE 100 - dup_pct < 90
        UNION ALL SELECT 3, CASE WHEN b < a THEN 'Investigate the revenue decline.' ELSE 'Keep up what drives the upward trend.' END
          FROM (SELECT arg_min(v, p) AS a, arg_max(v, p) AS b FROM
            (SELECT strftime(date, '%Y-%m') AS p, sum(total_amount) AS v FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 12)) WHERE a <> b
        UNION ALL (SELECT 4, 'Focus on ' || product_category || ': ' || {_money('sum(total_amount)')} || ' or '
          || format('{{:,.1f}}', {R('100 * sum(total_amount) / (SELECT sum(total_amount) FROM sales)', 1)}) || '% of revenue.'
          FROM sales GROUP BY product_category ORDER BY sum(total_amount) DESC, product_category LIMIT 1)
        UNION ALL SELECT 5, 'Run a retention campaign for ' || count(*) || ' customers at risk.' FROM churn WHERE score >= 40 HAVING count(*) > 0
        UNION ALL SELECT 6, 'Lift the average order value above ' || {_money('avg(total_amount)')} || '.' FROM sales""",
        INSIGHT_QUALITY,
        BASE_SQL.format(fact="sales"),
        CHURN_SQL,
    )
)
def recommendation_rows(spark, folder):
    rows = sales(spark, folder, ["date", "customer_id", "product_category", "total_amount"])
    return kpi.growth_recommendations(rows, profile.quality_score(rows), customers.churn_summary(rows))


@query(
    with_sales(
        f"""SELECT CAST(1 AS BIGINT) AS position, 'Data quality is ' || format('{{:,.2f}}', 100 - dup_pct) || '/100: 0.00% missing, '
          || format('{{:,.2f}}', dup_pct) || '% duplicate.' AS text FROM quality
        UNION ALL SELECT 2, 'Revenue ' || {_money('sum(total_amount)')} || ' in ' || format('{{:,}}', count(*)) || ' orders, '
          || {_money('avg(total_amount)')} || ' on average.' FROM sales
        UNION ALL (SELECT 3, 'Top contributor ' || product_category || ': ' || {_money('sum(total_amount)')} || ' or '
          || format('{{:,.1f}}', {R('100 * sum(total_amount) / (SELECT sum(total_amount) FROM sales)', 1)}) || '% of revenue.'
          FROM sales GROUP BY product_category ORDER BY sum(total_amount) DESC, product_category LIMIT 1)
        UNION ALL SELECT 4, 'Trend ' || CASE WHEN b > a THEN 'upward' WHEN b < a THEN 'downward' ELSE 'stable' END || ': ' || {_money('a')}
          || ' in ' || f || ', ' || {_money('b')} || ' in ' || l || '.' FROM turn
        UNION ALL SELECT 5, 'Risk: revenue is declining.' FROM turn WHERE b < a""",
        INSIGHT_QUALITY,
        """turn AS (SELECT min(p) AS f, max(p) AS l, arg_min(v, p) AS a, arg_max(v, p) AS b FROM
            (SELECT strftime(date, '%Y-%m') AS p, sum(total_amount) AS v FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 12))""",
    )
)
def executive_insights(spark, folder):
    rows = sales(spark, folder, ["date", "customer_id", "product_category", "total_amount"])
    return kpi.executive_insights(rows, profile.quality_score(rows))


@query(
    with_sales(
        f"""SELECT row_number() OVER (ORDER BY r DESC, name) AS rank, name, {R('r')} AS revenue FROM
        (SELECT segment AS name, sum(total_amount) AS r FROM sales GROUP BY 1 ORDER BY r DESC, 1 LIMIT 5)"""
    )
)
def top_segments(spark, folder):
    return tidy(kpi.top_categories(order_revenue(spark, folder, ["segment", "total_amount"]), "segment", 5))


CANONICAL = ["date", "customer_id", "transaction_id", "total_amount", "product_category", "country", "region"]


@query()
def gated_analysis_status(spark, folder):
    return run_basic(sales(spark, folder, CANONICAL)).outcome(spark)


@query()
def gated_modules_status(spark, folder):
    return run_advanced(sales(spark, folder, CANONICAL)).outcome(spark)


@query(
    with_sales(
        f"""SELECT bin, count(*) AS "rows", {R('min(lo) + (bin - 1) * ((min(hi) - min(lo)) / 20)')} AS bin_start FROM
        (SELECT least(CAST(floor(20 * (total_amount - lo) / (hi - lo)) AS BIGINT) + 1, 20) AS bin, lo, hi
         FROM sales, (SELECT min(total_amount) AS lo, max(total_amount) AS hi FROM sales)) GROUP BY 1"""
    )
)
def histogram_20(spark, folder):
    return tidy(kpi.histogram(sales(spark, folder, ["total_amount"]), "total_amount"))


@query(
    with_sales(
        f"""SELECT region, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3,
        {R('min(total_amount) FILTER (inside)')} AS whisker_low, {R('max(total_amount) FILTER (inside)')} AS whisker_high,
        count(*) FILTER (NOT inside) AS outliers FROM
        (SELECT s.region, total_amount, q1, median, q3,
           total_amount >= q1 - 1.5 * (q3 - q1) AND total_amount <= q3 + 1.5 * (q3 - q1) AS inside
         FROM sales s JOIN (SELECT region, quantile_cont(total_amount, 0.25) AS q1, quantile_cont(total_amount, 0.5) AS median,
           quantile_cont(total_amount, 0.75) AS q3 FROM sales GROUP BY 1) q ON s.region = q.region)
        GROUP BY region, q1, median, q3"""
    )
)
def box_stats(spark, folder):
    return tidy(kpi.box_stats(sales(spark, folder, ["region", "total_amount"]), "region", "total_amount"))


# ---- filters ----


@query(
    with_sales(
        KPI_SQL
        + """ FROM sales WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
        AND country IN ('NATION_1', 'NATION_7', 'NATION_12') AND product_category IN ('PROMO', 'LARGE')"""
    )
)
def filter_in_between(spark, folder):
    rows = sales(spark, folder, ["date", "customer_id", "total_amount", "country", "product_category"])
    members = {"country": ["NATION_1", "NATION_7", "NATION_12"], "product_category": ["PROMO", "LARGE"]}
    return tidy(kpi.business_kpis(filters.in_window(rows, "1997-01-01", "1998-12-31", members)))


@query(with_sales(KPI_SQL + " FROM sales WHERE lower(product_category) = lower('Promo')"))
def filter_category_ci(spark, folder):
    rows = sales(spark, folder, ["date", "customer_id", "total_amount", "product_category"])
    return tidy(kpi.business_kpis(filters.same_text(rows, "product_category", "Promo")))


DRILL = ["date", "customer_id", "transaction_id", "product_category", "quantity", "total_amount"]
DRILL_SQL = """drill AS (SELECT date, customer_id, transaction_id, product_category, quantity, total_amount FROM sales
  WHERE lower(product_category) = 'standard' AND date >= DATE '1996-06-01' AND date <= DATE '2000-06-30'
  ORDER BY date DESC, transaction_id, total_amount, quantity LIMIT 100)"""


def _drilled(spark, folder):
    return filters.drill_down(
        sales(spark, folder, DRILL), category="Standard", date_start="1996-06-01", date_end="2000-06-30",
        ties=("transaction_id", "total_amount", "quantity"),
    )


@query(with_sales(f"SELECT date, customer_id, transaction_id, product_category, {R('quantity')} AS quantity, {R('total_amount')} AS total_amount FROM drill", DRILL_SQL))
def drilldown_txn(spark, folder):
    return tidy(_drilled(spark, folder).withColumn("date", F.to_date("date")))


@query(with_sales(KPI_SQL + " FROM drill", DRILL_SQL))
def drilldown_summary(spark, folder):
    return tidy(kpi.business_kpis(_drilled(spark, folder)))


@query(
    f"""SELECT o_orderkey AS transaction_id, o_custkey AS employee_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount_x,
    {R('f.amount')} AS amount_y, c_mktsegment AS department
    FROM orders LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1) f
      ON CAST(o_orderdate AS DATE) = f.d
    LEFT JOIN customer ON o_custkey = c_custkey"""
)
def left_join_merge(spark, folder):
    left = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("employee_id"),
        F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("amount"),
    )
    finance = table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("amount"))
    hr = table(spark, folder, "customer").select(F.col("c_custkey").alias("employee_id"), F.col("c_mktsegment").alias("department"))
    merged = filters.merge_departments(left, finance, hr)
    return tidy(merged.select("transaction_id", "employee_id", "date", "amount_x", "amount_y", "department"))


@query("SELECT c_nationkey AS nationkey, 'customer' AS side FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier")
def union_distinct(spark, folder):
    sides = [("customer", "c_nationkey"), ("supplier", "s_nationkey")]
    return filters.union_distinct(
        [table(spark, folder, t).select(F.col(c).alias("nationkey"), F.lit(t).alias("side")) for t, c in sides]
    )


@query(
    """SELECT arg_min(t, p) AS text, min(p) AS position FROM
    (SELECT CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS t, p_partkey AS p FROM part) GROUP BY lower(t)"""
)
def first_spelling(spark, folder):
    names = table(spark, folder, "part").select(
        F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("text"),
        F.col("p_partkey").alias("position"),
    )
    return filters.first_spelling(names, "text", "position")


@query(
    """SELECT o_orderkey AS transaction_id, o_totalprice AS total_amount FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25"""
)
def bottom_orders(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("total_amount"))
    return filters.rank_by(rows, "total_amount", 25, "asc", ties=("transaction_id",))
