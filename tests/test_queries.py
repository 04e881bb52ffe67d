"""Every registered query against its SQL; and some again with joins by shuffle only."""

import pytest

import __spark_entry__ as entry
import oracle
from ledgerlens.plans import catalog

QUERIES, SQL = catalog.QUERIES, catalog.ORACLE
SHUFFLED = (
    "spend_tiers segment_regular clv clv_summary repeat_purchase_summary health_summary geography product_performance "
    "promo_impact_derived performance_score_tiers box_stats describe_stats deal_size affinity_rules left_join_merge"
).split()


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, con, name):
    assert oracle.compare(QUERIES[name](spark, folder), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


@pytest.mark.parametrize("name", SHUFFLED)
def test_shuffle_joins_match_sql(spark, folder, con, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert oracle.compare(QUERIES[name](spark, folder), con, SQL[name]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["country", "total_amount"] and df.count() == 5


def test_order_revenue_equals_the_lines(spark, folder):
    from pyspark.sql import functions as F

    from ledgerlens.plans.facts import order_revenue, sales

    columns = ["transaction_id", "region", "total_amount"]
    by_line = sales(spark, folder, columns).groupBy("transaction_id", "region").agg(F.round(F.sum("total_amount"), 4).alias("v"))
    by_order = order_revenue(spark, folder, columns).select("transaction_id", "region", F.round("total_amount", 4).alias("v"))
    assert by_line.exceptAll(by_order).isEmpty() and by_order.exceptAll(by_line).isEmpty()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)
