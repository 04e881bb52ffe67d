"""Registry of named queries and the pieces their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.edge import CLEAR_DIGITS, SPARE_DIGITS, edge_round

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

SALES = """sales AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS customer_id, o_orderkey AS transaction_id,
         l_extendedprice * (1 - l_discount) AS total_amount, l_quantity AS quantity, l_discount AS discount,
         p_type AS product_category, p_brand AS product, p_size AS size, 0.6 * l_quantity * p_retailprice AS cost,
         c_name AS customer_name, c_mktsegment AS segment, n_name AS country, r_name AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey)"""
ORDERS = """orders_fact AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS customer_id, o_orderkey AS transaction_id,
         o_totalprice AS total_amount, o_orderstatus AS status, c_name AS customer_name,
         c_mktsegment AS segment, n_name AS country, r_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, folder) -> DataFrame and its SQL."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def with_sales(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([SALES, *ctes]) + "\n" + body


def with_orders(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ORDERS, *ctes]) + "\n" + body


def R(expr: str, digits: int = 2) -> str:
    """``edge_round`` in decimals, as a double."""
    def rounded(kept: int) -> str:
        return f"CAST(round(TRY_CAST(({expr}) AS DECIMAL(38, {max(kept, digits + SPARE_DIGITS)})), {digits}) AS DOUBLE)"

    cases = " ".join(f"WHEN abs({expr}) < {limit} THEN {rounded(kept)}" for limit, kept in CLEAR_DIGITS)
    return f"CASE {cases} ELSE {rounded(0)} END"


def tidy(df: DataFrame, default: int = 2, **digits: int) -> DataFrame:
    """Round every double column for output."""
    return df.select(
        *[
            edge_round(F.col(f.name), digits.get(f.name, default)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
