"""Sales facts over the star-schema tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents", "embeddings",
    "pages", "benchmark", "labels",
)

# canonical column -> (tables it needs besides the fact, expression)
_ORDER_COLUMNS = {
    "date": ((), "o_orderdate"),
    "customer_id": ((), "o_custkey"),
    "transaction_id": ((), "o_orderkey"),
    "status": ((), "o_orderstatus"),
    "priority": ((), "o_orderpriority"),
    "customer_name": (("customer",), "c_name"),
    "segment": (("customer",), "c_mktsegment"),
    "country": (("customer", "nation"), "n_name"),
    "region": (("customer", "nation", "region"), "r_name"),
}
_LINE_COLUMNS = {
    **_ORDER_COLUMNS,
    "transaction_id": ((), "l_orderkey"),
    "total_amount": ((), "l_extendedprice * (1 - l_discount)"),
    "quantity": ((), "l_quantity"),
    "discount": ((), "l_discount"),
    "line_number": ((), "l_linenumber"),
    "product_category": (("part",), "p_type"),
    "product": (("part",), "p_brand"),
    "size": (("part",), "p_size"),
    "cost": (("part",), "0.6 * l_quantity * p_retailprice"),
}
_ORDER_ONLY = {**_ORDER_COLUMNS, "total_amount": ((), "o_totalprice")}



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _needed(catalogue: dict, columns: Sequence[str]) -> set[str]:
    return {t for c in columns for t in catalogue[c][0]}


def _select(rows: DataFrame, catalogue: dict, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[F.expr(catalogue[c][1]).alias(c) for c in columns])


def _orders(spark: SparkSession, folder: str, needed: set[str]) -> DataFrame:
    """Orders with the customer side asked for; the small tables meet the customers before the orders do."""
    orders = table(spark, folder, "orders")
    if "customer" not in needed:
        return orders
    people = table(spark, folder, "customer")
    if "nation" in needed:
        places = table(spark, folder, "nation")
        if "region" in needed:
            places = places.join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        people = people.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey"))


def sales(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """One row per order line with the canonical columns asked for; joins only the tables those need.

    The order side is complete before the lines join it, so the lines are
    shuffled once, on the order key, whatever customer columns are wanted.
    """
    needed = _needed(_LINE_COLUMNS, columns)
    lines = table(spark, folder, "lineitem")
    if any(c in _ORDER_COLUMNS and c != "transaction_id" for c in columns):
        lines = lines.join(_orders(spark, folder, needed), F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needed:
        lines = lines.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _select(lines, _LINE_COLUMNS, columns)


def orders_fact(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """One row per order with the canonical columns asked for."""
    return _select(_orders(spark, folder, _needed(_ORDER_ONLY, columns)), _ORDER_ONLY, columns)


def order_revenue(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """One row per order with its line total as ``total_amount``; for results that only sum.

    Lines are added up per order before the join: the map side shrinks them first
    (an order with a third of all lines is one row per task), and the join reuses
    the partitioning of the aggregate.
    """
    amount = F.expr(_LINE_COLUMNS["total_amount"][1])
    totals = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum(amount).alias("__total"))
    catalogue = {**_ORDER_COLUMNS, "total_amount": ((), "__total")}
    rows = totals.join(_orders(spark, folder, _needed(catalogue, columns)), F.col("l_orderkey") == F.col("o_orderkey"))
    return _select(rows, catalogue, columns)
