"""Schema discovery on the given tables under foreign column names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import mapping, profile
from ..analysis import ingest_frame
from ..facts import orders_fact, table
from .registry import R, query, tidy, with_orders


def foreign_orders(spark, folder):
    """Orders as a foreign system might export them: texts, other names, a currency sign."""
    rows = orders_fact(spark, folder, ["transaction_id", "date", "total_amount", "customer_id", "segment", "country"])
    return rows.select(
        F.concat(F.lit("T-"), F.col("transaction_id").cast("string")).alias("txn_ref"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("purchase_ts"),
        F.concat(F.lit("$"), F.format_number("total_amount", 2)).alias("gross_sales"),
        F.concat(F.lit("C"), F.col("customer_id").cast("string")).alias("client_code"),
        F.col("segment").alias("item_group"),
        F.col("country").alias("zone"),
    )


@query()
def mapping_candidates(spark, folder):
    return mapping.mapping_candidates(foreign_orders(spark, folder))


@query()
def mapping_auto(spark, folder):
    frame = foreign_orders(spark, folder)
    chosen = mapping.auto_map(frame)
    return spark.createDataFrame(sorted(chosen.items()), "role string, source string")


@query(
    with_orders(
        f"""SELECT strftime(date, '%Y') AS year, {R('sum(total_amount)')} AS revenue, count(DISTINCT segment) AS categories FROM orders_fact GROUP BY 1"""
    )
)
def remapped_years(spark, folder):
    """Columns under names near the known ones are found by confidence; the remapped table gives yearly figures."""
    orders = foreign_orders(spark, folder).select(
        F.col("purchase_ts").alias("Order_Date"), F.col("gross_sales").alias("Sales Amount"),
        F.col("client_code").alias("Client ID"), F.col("item_group").alias("Item Category"),
    )
    chosen = mapping.auto_remap(orders)
    frame = mapping.apply_manual_mapping(orders, chosen)
    by = frame.groupBy(F.date_format("date", "yyyy").alias("year"))
    return tidy(by.agg(F.sum("total_amount").alias("revenue"), F.count_distinct("product_category").alias("categories")))


@query(
    with_orders(
        """SELECT 1 AS position, 'customer_id' AS role, 'not unique' AS finding, 'major' AS severity,
        count(DISTINCT segment)::DOUBLE / count(segment) AS measure, 'Customer ID mapping is suspicious: not unique' AS issue
        FROM orders_fact HAVING count(DISTINCT segment)::DOUBLE / count(segment) <= 0.2"""
    )
)
def mapping_validation(spark, folder):
    """Issues of a deliberately weak mapping: a market segment as customer id."""
    frame = foreign_orders(spark, folder).select(
        F.col("purchase_ts").alias("date"), F.col("gross_sales").alias("total_amount"),
        F.col("item_group").alias("customer_id"), F.col("zone").alias("product_category"),
    )
    return mapping.mapping_issues(frame)


@query()
def detected_columns(spark, folder):
    """Date, amount, region and customer column of a foreign table, each by its own detector."""
    facts = mapping.column_facts(foreign_orders(spark, folder))
    return spark.createDataFrame([(role, mapping.detect(role, facts)) for role in mapping.DETECTORS], "role string, source string")


@query()
def analysis_plan(spark, folder):
    """What the ingested table allows, next to its row count."""
    data = ingest_frame(foreign_orders(spark, folder))
    plan = mapping.analysis_plan(spark, data.frame.columns)
    rows = data.frame.agg(F.count(F.lit(1)).alias("n"))
    return plan.withColumn("mode", F.lit(data.mode)).withColumn("clean_rows", rows.scalar())


@query(
    with_orders(
        f"""SELECT strftime(date, '%Y-%m') AS month_year, count(*) AS n, {R('sum(total_amount)')} AS revenue FROM orders_fact GROUP BY 1"""
    )
)
def ingest_months(spark, folder):
    """Ingest the foreign table without any hint and report revenue by month."""
    frame = ingest_frame(foreign_orders(spark, folder)).frame
    return tidy(frame.groupBy("month_year").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("revenue")))


@query(
    with_orders(
        f"""SELECT strftime(date, '%Y') AS year, {R('sum(total_amount)')} AS revenue, count(DISTINCT customer_id) AS customers FROM orders_fact GROUP BY 1"""
    )
)
def manual_mapping(spark, folder):
    chosen = {"date": "purchase_ts", "total_amount": "gross_sales", "customer_id": "client_code", "product_category": "item_group"}
    frame = mapping.apply_manual_mapping(foreign_orders(spark, folder), chosen)
    by = frame.groupBy(F.date_format("date", "yyyy").alias("year"))
    return tidy(by.agg(F.sum("total_amount").alias("revenue"), F.count_distinct("customer_id").alias("customers")))


def _kind_sql(column: str, expr: str, source: str) -> str:
    """The 80 % rule for a text column."""
    number = f"count(TRY_CAST(trim({expr}) AS DOUBLE)) / count({expr})"
    date = f"count(TRY_CAST({expr} AS DATE)) / count({expr})"
    return f"""SELECT '{column}' AS "column", CASE WHEN {date} >= 0.8 AND {date} >= {number} THEN 'date'
      WHEN {number} >= 0.8 THEN 'number' ELSE 'text' END AS inferred_type FROM {source}"""


@query(
    " UNION ALL ".join(
        [
            _kind_sql("o_orderpriority", "o_orderpriority", "orders"),
            _kind_sql("o_orderstatus", "o_orderstatus", "orders"),
            _kind_sql("text_number", "CAST(o_totalprice AS VARCHAR)", "orders"),
            _kind_sql("text_date", "strftime(o_orderdate, '%Y-%m-%d')", "orders"),
            "SELECT 'o_custkey', CASE WHEN count(o_custkey) > 0 THEN 'number' END FROM orders",
            "SELECT 'o_orderdate', CASE WHEN count(o_orderdate) > 0 THEN 'date' END FROM orders",
            _kind_sql("c_name", "c_name", "customer"),
        ]
    )
)
def inferred_types(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderdate",
        F.format_string("%.2f", F.col("o_totalprice")).alias("text_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text_date"),
    )
    names = table(spark, folder, "customer").select("c_name")
    parts = [profile.infer_types(orders), profile.infer_types(names)]
    return reduce(DataFrame.unionByName, parts)
