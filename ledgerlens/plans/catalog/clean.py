"""Cleaning and profiling. The messy texts are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.coerce import clean_dimension, normal_key, sanitize_text, to_number
from ...operators import clean, kpi, profile
from ..facts import orders_fact, sales, table
from .registry import R, query, tidy, with_orders, with_sales

MESSY_AMOUNT_SQL = """messy AS (SELECT o_orderkey AS transaction_id, CASE o_orderkey % 5
    WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN '(' || format('{:,.2f}', o_totalprice) || ')'
    WHEN 2 THEN ' USD ' || format('{:,.2f}', o_totalprice) || ' ' WHEN 3 THEN '-' ELSE CAST(o_orderkey AS VARCHAR) || '.5 EUR' END AS amount FROM orders)"""


def messy_amounts(spark, folder):
    price = F.format_number("o_totalprice", 2)
    turn = F.col("o_orderkey") % 5
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(turn == 0, F.concat(F.lit("$"), price))
        .when(turn == 1, F.concat(F.lit("("), price, F.lit(")")))
        .when(turn == 2, F.concat(F.lit(" USD "), price, F.lit(" ")))
        .when(turn == 3, F.lit("-"))
        .otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".5 EUR")))
        .alias("amount"),
    )


@query(
    "WITH "
    + MESSY_AMOUNT_SQL
    + r""" SELECT transaction_id, TRY_CAST(regexp_replace(regexp_replace(trim(amount), '\(([^)]+)\)', '-\1', 'g'), '[^0-9.\-]', '', 'g') AS DOUBLE) AS amount FROM messy"""
)
def clean_amounts(spark, folder):
    return clean.parse_numbers(messy_amounts(spark, folder), "amount")


@query(
    """SELECT o_orderkey AS transaction_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders"""
)
def clean_dates(spark, folder):
    texts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderkey") % 7 == 0, "not known")
        .when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "d-M-yyyy"))
        .alias("date"),
    )
    return clean.parse_dates(texts, "date").withColumn("date", F.to_date("date"))


@query("SELECT c_custkey AS customer_id, upper(c_name) AS full_name, nullif(c_mktsegment, 'BUILDING') AS market FROM customer")
def clean_headers(spark, folder):
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("CustomerblankID"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit(" blank")).alias("Full  Name"),
        F.when(F.col("c_mktsegment") == "BUILDING", " None ").otherwise(F.col("c_mktsegment")).alias(" Market "),
    )
    return clean.standard_headers(clean.sanitize(raw))


@query(
    """SELECT seg, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer) GROUP BY 1"""
)
def clean_dims(spark, folder):
    values = F.array(*[F.lit(v) for v in ("unknown", " N/A ", "NULL", "")])
    raw = table(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 4 == 0, values[(F.col("c_custkey") % 16 / 4).cast("int")])
        .otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("  ")))
        .alias("seg")
    )
    return raw.select(clean_dimension(F.col("seg")).alias("seg")).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS key,
    nullif(CASE WHEN p_size > 40 THEN 'na' ELSE p_name || ' ' || p_type END, 'na') AS label, p_size - CAST(0.5 AS DOUBLE) AS number FROM part"""
)
def clean_texts(spark, folder):
    p = table(spark, folder, "part")
    messy = F.when(F.col("p_size") > 40, " NA ").otherwise(F.concat("p_name", F.lit(" blank "), "p_type", F.lit("\n")))
    return p.select(
        "p_partkey",
        normal_key(F.concat("p_name", F.lit("blank"), "p_brand")).alias("key"),
        sanitize_text(messy).alias("label"),
        to_number(F.concat(F.lit("size "), (F.col("p_size") - 0.5).cast("string"))).alias("number"),
    )


@query(
    with_orders(
        f"""SELECT dealsize AS dimension, count(*) AS n, {R('sum(total_amount)')} AS revenue FROM
        (SELECT total_amount, CASE WHEN total_amount <= q33 THEN 'Small' WHEN total_amount <= q66 THEN 'Medium' ELSE 'Large' END AS dealsize
         FROM orders_fact, (SELECT quantile_cont(total_amount, 0.33) AS q33, quantile_cont(total_amount, 0.66) AS q66 FROM orders_fact)) GROUP BY 1"""
    )
)
def deal_size(spark, folder):
    frame = clean.visual_frame(orders_fact(spark, folder, ["date", "total_amount", "country", "customer_id"]))
    return tidy(frame.groupBy(F.col("dealsize").alias("dimension")).agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("revenue")))


@query(
    with_orders(
        f"""SELECT 'dealsize' AS dimension, arg_max(d, v) AS top_member, {R('max(v)')} AS top_revenue FROM
        (SELECT CASE WHEN total_amount <= q33 THEN 'Small' WHEN total_amount <= q66 THEN 'Medium' ELSE 'Large' END AS d, sum(total_amount) AS v
         FROM orders_fact, (SELECT quantile_cont(total_amount, 0.33) AS q33, quantile_cont(total_amount, 0.66) AS q66 FROM orders_fact) GROUP BY 1)"""
    )
)
def top_deal_size(spark, folder):
    frame = clean.visual_frame(orders_fact(spark, folder, ["date", "total_amount"]))
    best = kpi.extremes(frame, {"dealsize": "dealsize"}, "sales")
    return tidy(best.select("dimension", "top_member", "top_revenue"))


@query(
    """SELECT o_orderkey AS transaction_id, year(o_orderdate) AS year, month(o_orderdate) AS month, quarter(o_orderdate) AS quarter,
    monthname(o_orderdate) AS month_name FROM orders"""
)
def time_features(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_orderdate").alias("date"))
    return clean.add_time_features(rows).drop("date")


DUP_SQL = """dup AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber * CAST(1.5 AS DOUBLE) END AS weight,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE 'x' END AS tag FROM lineitem)"""


def _with_duplicates(spark, folder):
    n = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(n != 3, n * F.lit(1.5)).alias("weight"),
        F.when(n != 5, F.lit("x")).alias("tag"),
    )


@query("WITH " + DUP_SQL + " SELECT DISTINCT l_orderkey, l_linenumber, coalesce(weight, 0) AS weight, tag FROM dup")
def dedupe_fill(spark, folder):
    return clean.dedupe_fill(_with_duplicates(spark, folder), 0)


@query("WITH " + DUP_SQL + " SELECT DISTINCT l_orderkey, l_linenumber, weight, coalesce(tag, 'Unknown') AS tag FROM dup")
def dedupe_fill_text(spark, folder):
    return clean.dedupe_fill(_with_duplicates(spark, folder), "Unknown")


@query(f"SELECT l_orderkey, l_linenumber, {R('l_quantity * l_extendedprice')} AS revenue, {R('l_quantity * l_extendedprice - l_tax')} AS profit FROM lineitem")
def revenue_profit_columns(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("cost")
    )
    return tidy(clean.add_profit(clean.add_revenue(rows)).drop("quantity", "price", "cost"))


@query(
    with_sales(
        f"""SELECT strftime(date, '%Y-%m') AS month_year, count(*) AS n, {R('sum(total_amount)')} AS revenue FROM sales
        WHERE transaction_id % 9 <> 0 GROUP BY 1"""
    )
)
def canonical_months(spark, folder):
    """Map foreign column names to roles, type them, and drop the incomplete rows."""
    raw = sales(spark, folder, ["date", "customer_id", "transaction_id", "total_amount"]).select(
        F.date_format("date", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("transaction_id") % 9 != 0, F.col("total_amount").cast("string")).alias("net_sales"),
        F.col("customer_id").alias("client_id"),
    )
    frame = clean.canonical_frame(raw, {"date": "order_date", "total_amount": "net_sales", "customer_id": "client_id"})
    return tidy(frame.groupBy("month_year").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("revenue")))


# ---- profiling ----

ORDER_COLUMNS = {
    "o_orderkey": ("bigint", "number"), "o_custkey": ("bigint", "number"), "o_orderstatus": ("string", "text"),
    "o_totalprice": ("double", "number"), "o_orderdate": ("timestamp_ntz", "time"), "o_orderpriority": ("string", "text"),
}


def _profile_sql() -> str:
    parts = []
    for i, (name, (dtype, shape)) in enumerate(ORDER_COLUMNS.items()):
        rate = "100.0" if shape != "text" else "0.0"
        number = "100.0" if shape != "text" else f"100.0 * count(TRY_CAST(trim({name}) AS DOUBLE)) / count(*)"
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS position, '{name}' AS "column", '{dtype}' AS dtype, count(*) - count({name}) AS null_count,
            {R(f'100.0 * (count(*) - count({name})) / count(*)')} AS null_pct, count(DISTINCT {name}) AS unique_count,
            (SELECT list(v ORDER BY md5(v)) FROM (SELECT DISTINCT CAST({name} AS VARCHAR) AS v FROM orders WHERE {name} IS NOT NULL ORDER BY md5(v) LIMIT 3)) AS samples,
            {R(rate)} AS date_parse_pct, {R(number)} AS numeric_parse_pct FROM orders"""
        )
    return " UNION ALL ".join(parts)


@query(_profile_sql())
def profile_columns(spark, folder):
    return profile.profile_columns(table(spark, folder, "orders"))


@query()
def profile_columns_sketch(spark, folder):
    return profile.profile_columns(table(spark, folder, "lineitem"), exact=False)


@query(
    "WITH "
    + DUP_SQL
    + """ SELECT 'l_orderkey' AS "column", count(*) - count(l_orderkey) AS missing_count, 0.0 AS missing_pct, 'number' AS inferred_type FROM dup
    UNION ALL SELECT 'l_linenumber', count(*) - count(l_linenumber), 0.0, 'number' FROM dup
    UNION ALL SELECT 'weight', count(*) - count(weight), """
    + R("100.0 * (count(*) - count(weight)) / count(*)")
    + """, 'number' FROM dup UNION ALL SELECT 'tag', count(*) - count(tag), """
    + R("100.0 * (count(*) - count(tag)) / count(*)")
    + """, 'text' FROM dup"""
)
def health_snapshot(spark, folder):
    return tidy(profile.health_snapshot(_with_duplicates(spark, folder))["columns"])


@query(
    "WITH "
    + DUP_SQL
    + """ SELECT "column", missing_count FROM (SELECT 'weight' AS "column", count(*) - count(weight) AS missing_count FROM dup
    UNION ALL SELECT 'tag', count(*) - count(tag) FROM dup UNION ALL SELECT 'l_linenumber', 0 UNION ALL SELECT 'l_orderkey', 0)
    ORDER BY missing_count DESC, "column" LIMIT 3"""
)
def top_missing(spark, folder):
    return profile.top_missing(_with_duplicates(spark, folder), 3).select("column", "missing_count")


DUPLICATES = """counted AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS d FROM
  (SELECT count(*) AS c FROM dup GROUP BY l_orderkey, l_linenumber, weight, tag))"""


@query("WITH " + DUP_SQL + ", " + DUPLICATES + f" SELECT n AS total_rows, d AS duplicate_rows, {R('100.0 * d / n')} AS duplicate_pct FROM counted")
def duplicate_rows(spark, folder):
    return profile.duplicate_rows(_with_duplicates(spark, folder))


@query(
    "WITH "
    + DUP_SQL
    + ", "
    + DUPLICATES
    + f""" SELECT n AS row_count, CAST(4 AS BIGINT) AS column_count, {R('m')} AS missing_pct, {R('p')} AS duplicate_pct,
    {R('greatest(0.0, least(100.0, 100.0 - m - p))')} AS quality_score FROM
    (SELECT n, 100.0 * d / n AS p, (SELECT 100.0 * (2 * count(*) - count(weight) - count(tag)) / (4 * count(*)) FROM dup) AS m FROM counted)"""
)
def quality_score(spark, folder):
    return profile.quality_score(_with_duplicates(spark, folder))


def _summary_sql(*columns: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {R(f'avg({c})')} AS mean, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max,
        {R(f'stddev_samp({c})')} AS std FROM lineitem"""
        for c in columns
    )


@query(_summary_sql("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
def exploratory_summary(spark, folder):
    return tidy(profile.exploratory_summary(table(spark, folder, "lineitem"))["numeric"])


TEXTS = ("l_returnflag", "l_linestatus", "l_shipdate")


@query(
    """SELECT "column", value, count, position FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS position FROM ("""
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2""" for c in TEXTS)
    + ")) WHERE position <= 5"
)
def exploratory_top_values(spark, folder):
    return profile.top_values(table(spark, folder, "lineitem"))


@query(
    f"""SELECT 'o_totalprice' AS "column", count(o_totalprice) AS count, {R('avg(o_totalprice)')} AS mean, {R('stddev_samp(o_totalprice)')} AS std,
    {R('min(o_totalprice)')} AS min, {R('max(o_totalprice)')} AS max, {R('quantile_cont(o_totalprice, 0.25)')} AS q25,
    {R('quantile_cont(o_totalprice, 0.5)')} AS q50, {R('quantile_cont(o_totalprice, 0.75)')} AS q75 FROM orders"""
)
def describe_stats(spark, folder):
    return tidy(profile.describe(table(spark, folder, "orders"), "o_totalprice"))


@query("""SELECT count(*) AS "rows", CAST(6 AS BIGINT) AS columns, 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS names FROM orders""")
def table_shape(spark, folder):
    return profile.shape(table(spark, folder, "orders"))


@query(with_sales("SELECT product_category AS value, min(date) AS min_date, max(date) AS max_date FROM sales GROUP BY 1"))
def filter_values(spark, folder):
    return profile.filter_values(sales(spark, folder, ["product_category", "date"]))


@query(
    with_sales(
        """SELECT 'country' AS dimension, count(DISTINCT country) AS members, count(DISTINCT country) >= 2 AS groupable FROM sales
        UNION ALL SELECT 'segment', count(DISTINCT segment), count(DISTINCT segment) >= 2 FROM sales"""
    )
)
def groupable_dims(spark, folder):
    return profile.groupable(sales(spark, folder, ["country", "segment"]), ["country", "segment"])
