"""Hand-computed results on small tables."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import clean, customers, filters, kpi, products, profile, timeseries
from ledgerlens.operators.scale import exact_quantiles, one_row


def approx(value, digits=1e-4):
    return pytest.approx(value, abs=digits)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_kpis(full_mode):
    k = kpi.business_kpis(full_mode).first()
    assert (k.total_revenue, k.average_order_value, k.unique_customers, k.total_orders) == (1275.0, 212.5, 5, 6)
    assert (str(k.start_date), str(k.end_date)) == ("2024-01-01", "2024-02-05")


def test_breakdowns(full_mode):
    cats = [(r["rank"], r["name"], r["revenue"]) for r in kpi.top_categories(full_mode).orderBy("rank").collect()]
    assert cats == [(1, "Electronics", 770.0), (2, "Beauty", 330.0), (3, "Home", 95.0), (4, "Grocery", 80.0)]
    months = {r["period"]: r["revenue"] for r in kpi.revenue_by_period(full_mode, "month").collect()}
    assert months == {"2024-01": 1180.0, "2024-02": 95.0}


def test_spend_quantiles_and_tiers(full_mode):
    spend = full_mode.groupBy("customer_id").agg(F.sum("total_amount").alias("s"))
    q = one_row(exact_quantiles(spend, "s", {"q25": 0.25, "q33": 0.33, "q66": 0.66, "q75": 0.75}))
    assert [q[k] for k in ("q25", "q33", "q66", "q75")] == [approx(95.0), approx(131.8), approx(280.4), approx(320.0)]
    tiers = by(kpi.spend_tiers(full_mode), "tier")
    assert {t: (r["customers"], r["revenue"]) for t, r in tiers.items()} == {
        "Premium": (2, 890.0), "Standard": (1, 210.0), "Basic": (2, 175.0), "Total": (5, 1275.0),
    }
    assert tiers["Premium"]["percent"] == 40.0


@pytest.mark.parametrize(
    "customer, freq, spend, recency, health, churn",
    [
        ("C1", 2, 570, 14, 85.0, 7.7778),
        ("C2", 1, 320, 28, 37.5, 39.3275),
        ("C3", 1, 80, 21, 28.1, 43.8596),
        ("C4", 1, 210, 7, 52.2, 31.5205),
        ("C5", 1, 95, 0, 51.7, 31.6667),
    ],
)
def test_customer_scores(full_mode, customer, freq, spend, recency, health, churn):
    h = by(customers.health_scores(full_mode), "customer_id")[customer]
    c = by(customers.churn_scores(full_mode), "customer_id")[customer]
    assert (h.frequency, h.monetary_value, h.recency_days, h.health_score) == (freq, spend, recency, health)
    assert (c.recency_days, c.churn_risk_score) == (recency, approx(churn))
    assert by(customers.rfm(full_mode), "customer_id")[customer].recency == recency + 1


def test_zscores(full_mode):
    z = [r["zscore"] for r in timeseries.flag_anomalies(full_mode, 0.0).orderBy("date").collect()]
    assert z == [approx(v) for v in (0.6297, 0.7318, 0.9020, 1.6168, 0.0170, 0.7999)]
    assert timeseries.flag_anomalies(full_mode).count() == 0
    assert timeseries.anomaly_summary(full_mode).first()["std_deviation"] == approx(146.892818)


def test_quality_falls_with_missing_values(full_mode):
    assert profile.quality_score(full_mode).first()["quality_score"] == 100.0
    holed = full_mode.withColumn("product_category", F.when(F.col("total_amount") != 120, F.col("product_category")))
    holed = holed.withColumn("total_amount", F.when(F.col("total_amount") != 320, F.col("total_amount")))
    assert profile.quality_score(holed).first()["quality_score"] == 91.67


@pytest.fixture(scope="module")
def chat_rows(spark):
    """Twelve purchases of seven customers over two months; three cells are empty."""
    rows = [
        ("C001", "2024-01-03", 200.0), ("C002", "2024-01-05", 250.0), ("C003", "2024-01-08", 330.0), ("C004", "2024-01-10", 400.0),
        ("C001", "2024-02-01", 300.0), ("C002", "2024-02-04", 260.0), ("C004", "2024-02-07", 200.0),
        ("C005", "2024-02-11", 310.0), ("C006", "2024-02-12", 300.0), ("C007", "2024-02-13", 300.0),
    ]
    df = spark.createDataFrame(rows, "customer_id string, date string, total_amount double")
    return df.withColumn("date", F.to_timestamp("date"))


def test_cohorts(chat_rows):
    cells = {(r.cohort_month, r.months_since): r for r in customers.cohort_table(chat_rows).collect()}
    assert (cells["2024-01", 0].customers, cells["2024-01", 0].revenue) == (4, 1180.0)
    assert (cells["2024-01", 1].customers, cells["2024-01", 1].revenue, cells["2024-01", 1].retention_rate) == (3, 760.0, 75.0)
    assert (cells["2024-02", 0].customers, cells["2024-02", 0].revenue) == (3, 910.0)
    matrix = {(r.cohort_month, r.months_since): r.retention_rate for r in customers.cohort_matrix(chat_rows).collect()}
    assert matrix == {("2024-01", 0): 100.0, ("2024-01", 1): 75.0, ("2024-02", 0): 100.0, ("2024-02", 1): 0.0}
    insight = customers.cohort_insights(chat_rows).first()
    assert (insight.best_cohort, insight.worst_cohort, insight.avg_month_1_retention) == ("2024-01", "2024-02", 75.0)


def test_repeat_purchase(chat_rows):
    s = customers.repeat_summary(chat_rows).first()
    assert (s.total_customers, s.repeat_customers, s.one_time_customers) == (7, 3, 4)
    gaps = {r.customer_id: r.avg_gap_days for r in customers.purchase_gaps(chat_rows).collect()}
    assert (gaps["C001"], gaps["C002"], gaps["C004"], gaps["C003"]) == (29.0, 30.0, 28.0, None)


def test_gaps_inside_a_day_count_as_zero(spark):
    times = ["2024-01-01 08:00", "2024-01-01 20:00", "2024-01-03 07:00", "2024-01-03 09:00"]
    df = spark.createDataFrame([("A", t) for t in times], "customer_id string, date string").withColumn("date", F.to_timestamp("date"))
    row = customers.purchase_gaps(df).first()
    # 12 h -> 0 days, 35 h -> 1 day, 2 h -> 0 days
    assert (row.avg_gap_days, row.min_gap_days, row.max_gap_days) == (approx(1 / 3), 0, 1)


def test_segments(full_mode):
    loyal = {r.customer_id for r in customers.segment_members(full_mode, "Loyal Customers").collect()}
    risk = {r.customer_id for r in customers.segment_members(full_mode, "At-Risk Customers").collect()}
    assert loyal == {"C1", "C2"} and risk == {"C2", "C3", "C4", "C5"}
    assert customers.segment_rows(full_mode, "loyal customers").count() == 3
    with pytest.raises(ValueError):
        customers.segment_members(full_mode, "unknown")


def test_lifetime_value(full_mode):
    rows = by(customers.lifetime_value(full_mode), "customer_id")
    assert (rows["C1"]["rank"], rows["C1"].tier, rows["C1"].lifetime_days, rows["C1"].purchase_gap_days) == (1, "high", 21, 21.0)
    assert rows["C3"].purchase_gap_days == 0.0 and rows["C3"].tier == "low"
    s = customers.lifetime_summary(full_mode).first()
    assert (s.total_customers, s.top_20_pct_count, s.top_20_pct_revenue, s.median_clv) == (5, 1, 570.0, 210.0)


# ---- baskets ----


def test_affinity_counts_distinct_items(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "d -> e"), (4, "b"), (5, None)]
    df = spark.createDataFrame(rows, "transaction_id long, product_category string")
    rules, items, total = products.all_rules(df, min_support=0.1, min_confidence=0.0)
    assert total == 5
    assert {(r.item, r.frequency) for r in items.collect()} == {("a", 3), ("b", 3), ("c", 1), ("d -> e", 1)}
    found = {(r.product_a, r.product_b): r for r in rules.collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "d -> e")}
    rule = found["a", "b"]
    assert (rule.co_purchase_count, rule.support, rule.confidence) == (2, 0.4, approx(2 / 3))
    assert rule.lift == approx(0.4 / 0.36) and rule.strength == "Moderate"


def test_affinity_against_brute_force(spark, folder):
    from collections import Counter
    from itertools import combinations

    from ledgerlens.plans.facts import sales

    df = sales(spark, folder, ["transaction_id", "product"])
    baskets = {}
    for r in df.collect():
        baskets.setdefault(r.transaction_id, set()).add(r["product"])
    pairs = Counter(p for items in baskets.values() for p in combinations(sorted(items), 2))
    got = products.pair_counts(products.basket_items(df, "product", "transaction_id"), products.frequent_items(products.basket_items(df, "product", "transaction_id"), 1e-6)[0])
    assert {(r.product_a, r.product_b): r.co_purchase_count for r in got.collect()} == dict(pairs)


def test_affinity_needs_a_support(spark):
    df = spark.createDataFrame([(1, "a")], "transaction_id long, product_category string")
    with pytest.raises(ValueError):
        products.affinity_rules(df, min_support=0.0)


# ---- promotions ----


def test_promo_truth_values(spark):
    df = spark.createDataFrame(
        [("yes", 10.0), ("0", 20.0), ("False", 30.0), (None, 40.0), ("TRUE", 50.0)], "promo string, total_amount double"
    )
    row = products.promo_impact(df, "promo").first()
    assert (row.promotional_transactions, row.promo_total_revenue, row.avg_order_lift) == (2, 60.0, 0.0)
    assert (row.effectiveness_rating, row.recommendation) == ("Negative", "Maintain current level")


# ---- cleaning ----


@pytest.mark.parametrize(
    "text, value",
    [
        ("$1,250.50", 1250.5), ("(1,234.50)", -1234.5), ("-", None), ("$", None), (".", None), ("12 EUR", 12.0), ("-3", -3.0),
        ("1.2.3", None), ("7-1", None), (None, None), ("abc", None), ("+5", 5.0), ("1e5", 15.0),
    ],
)
def test_numbers(spark, text, value):
    from ledgerlens.functions.coerce import to_number

    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == value


@pytest.mark.parametrize(
    "text, month_first, day_first",
    [
        ("2024-03-02", "2024-03-02", "2024-03-02"), ("03/02/2025", "2025-03-02", "2025-02-03"), ("25/02/2025", None, "2025-02-25"),
        ("2024-01-05T10:11:12", "2024-01-05", "2024-01-05"), ("5 Jan 2024", "2024-01-05", "2024-01-05"),
        ("Jan 5, 2024", "2024-01-05", "2024-01-05"), ("2024/1/5", "2024-01-05", "2024-01-05"), ("3-4-2024 12:30", "2024-03-04", "2024-04-03"),
        ("12:30", None, None), ("hello", None, None), ("", None, None), (None, None, None), ("C123", None, None), ("999", None, None),
    ],
)
def test_dates(spark, text, month_first, day_first):
    from ledgerlens.functions.coerce import to_time

    row = spark.createDataFrame([(text,)], "t string").select(
        F.to_date(to_time(F.col("t"))).cast("string"), F.to_date(to_time(F.col("t"), True)).cast("string")
    ).first()
    assert tuple(row) == (month_first, day_first)


def test_sanitize(spark):
    df = spark.createDataFrame([("Transactionblank  one", " NULL "), ("x\n y", "")], ["TransactionblankDate", "b  c"])
    out = clean.sanitize(df)
    assert out.columns == ["Transaction Date", "b c"]
    assert [tuple(r) for r in out.collect()] == [("Transaction one", None), ("x y", None)]


def test_age_bands(spark):
    ages = [0, 1, 25, 26, 35, 36, 45, 46, 200, 201, None]
    df = spark.createDataFrame([(a,) for a in ages], "a int").select(clean.age_band(F.col("a")))
    assert [r[0] for r in df.collect()] == [
        None, "18-25", "18-25", "26-35", "26-35", "36-45", "36-45", "46+", "46+", None, None,
    ]


def test_deal_size(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)] + [(None,)], "sales double")
    sizes = {r["dealsize"]: r["count"] for r in clean.deal_size(df).groupBy("dealsize").count().collect()}
    assert sizes == {"Small": 33, "Medium": 34, "Large": 34}
    empty = spark.createDataFrame([(None,)], "sales double")
    assert clean.deal_size(empty).first()["dealsize"] == "Medium"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 5, 10, 10)], "x double")
    bins = {r["bin"]: r["rows"] for r in kpi.histogram(df, "x", 20).collect()}
    assert bins == {1: 1, 11: 1, 20: 2}
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["rows"] for r in kpi.histogram(same, "x").collect()] == [2]


# ---- filters ----


def test_drill_down(full_mode):
    rows = filters.drill_down(full_mode, category="beauty", date_start="2024-01-02", limit=5).collect()
    assert [(r.customer_id, r.total_amount) for r in rows] == [("C4", 210.0)]
    assert filters.drill_down(full_mode, limit=2).count() == 2
    assert filters.drill_down(full_mode, customer="c1").count() == 2


def test_last_days_keeps_the_edge(full_mode):
    assert filters.last_days(full_mode, 14).count() == 3
    assert filters.last_days(full_mode, None).count() == 6


def test_left_merge_keeps_fan_out_and_renames(spark):
    left = spark.createDataFrame([("d1", 1), ("d2", 2)], "date string, v int")
    right = spark.createDataFrame([("d1", 10), ("d1", 11)], "date string, v int")
    out = filters.left_merge(left, right, "date")
    assert sorted(out.columns) == ["date", "v_x", "v_y"] and out.count() == 3
    assert filters.left_merge(left, right, "nope") is left


def test_first_spelling(spark):
    df = spark.createDataFrame([("Grow", 2), ("grow", 1), ("Keep", 3)], "text string, position int")
    assert {tuple(r) for r in filters.first_spelling(df, "text", "position").collect()} == {("grow", 1), ("Keep", 3)}


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0), ("a", None)], "k string, v double")
    assert [tuple(r) for r in kpi.aggregate(df, "k", "v", "count").collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        kpi.aggregate(df, "k", "v", "median")


# ---- edges ----


def test_empty_table(spark, full_mode):
    empty = full_mode.where(F.lit(False))
    k = kpi.business_kpis(empty).first()
    assert (k.total_revenue, k.total_orders, k.unique_customers) == (0.0, 0, 0)
    assert customers.lifetime_value(empty).count() == 0
    assert customers.churn_summary(empty).first()["total_customers"] == 0
    assert timeseries.resample(empty, "D").count() == 0
    assert timeseries.smooth_forecast(timeseries.resample(empty, "D")).count() == 0
    assert timeseries.decomposition_stats(timeseries.resample(empty, "D")).count() == 0
    assert products.affinity_rules(empty, basket="customer_id").count() == 0
    assert profile.quality_score(empty).first()["quality_score"] == 100.0


def test_one_row(spark, full_mode):
    one = full_mode.limit(1)
    assert customers.health_scores(one).first()["health_score"] == 100.0
    assert kpi.mean_growth(one, "month", "g").first()["g"] is None
    assert customers.lifetime_summary(one).first()["std_clv"] is None


def test_all_amounts_missing(full_mode):
    bare = full_mode.withColumn("total_amount", F.lit(None).cast("double"))
    assert kpi.business_kpis(bare).first()["total_revenue"] == 0.0
    assert {r.monetary for r in customers.rfm(bare).collect()} == {0.0}
    assert timeseries.flag_anomalies(bare).count() == 0


def test_zero_period_before_gives_no_growth(spark):
    df = spark.createDataFrame([("2024-01-01", 0.0), ("2024-02-01", 5.0), ("2024-04-01", 10.0)], "d string, total_amount double")
    df = df.select(F.to_date("d").alias("date"), "total_amount")
    growth = [r["growth"] for r in kpi.growth_table(df, "month").orderBy("period_start").collect()]
    assert growth == [None, None, -1.0, None]


def test_hot_customer(spark):
    """A third of all rows belong to one customer; nothing is dropped."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("customer_id"),
        F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 50 as int))").alias("date"),
        F.lit(1.0).alias("total_amount"),
    )
    assert by(customers.purchase_gaps(rows), "customer_id")["hot"].purchase_count == 1000
    assert customers.lifetime_value(rows).where("rank = 1").first()["clv"] == 1000.0
    assert customers.cohort_table(rows).agg(F.sum("revenue")).first()[0] == 3000.0


def test_matrices_lose_no_year_and_no_month(spark):
    rows = [("a", "1999-05-03", 10.0, "c1"), ("b", "2003-07-01", 90.0, "c1"), ("a", "2011-07-01", 5.0, "c2"), (None, "2012-01-01", 7.0, None)]
    df = spark.createDataFrame(rows, "region string, date string, total_amount double, customer_id string").withColumn("date", F.to_timestamp("date"))
    years = {(r.month, r.year): r.revenue for r in kpi.month_year_matrix(df).collect()}
    assert years == {(5, 1999): 10.0, (7, 2003): 90.0, (7, 2011): 5.0, (1, 2012): 7.0}
    cells = {(r.region, r.month): r.revenue for r in kpi.region_month_matrix(df).collect()}
    assert len(cells) == 2 * 153 and sum(cells.values()) == 105.0 and cells["b", "2003-07"] == 90.0 and cells["a", "2003-07"] == 0.0
    old = spark.createDataFrame([("c1", "1999-05-03", 1.0), ("c1", "2011-05-03", 2.0)], "customer_id string, date string, total_amount double")
    kept = customers.cohort_matrix(old.withColumn("date", F.to_timestamp("date")))
    assert {r.months_since: r.retention_rate for r in kept.collect()} == {m: 100.0 if m in (0, 144) else 0.0 for m in range(145)}


def test_samples_are_the_values_of_least_md5(spark):
    """Few and many different values, repeated, blank and very long ones; and estimates so wrong that a column is asked again."""
    import hashlib

    from ledgerlens.operators import profile

    rows = [(f"v{k % 5}", k, "x" * 500 + str(k % 700) if k % 3 else None, None) for k in range(4000)]
    df = spark.createDataFrame(rows, "few string, many long, long string, none string")
    found = {r["column"]: r.samples for r in profile.distinct_samples(df, 4).collect()}
    for i, name in enumerate(("few", "many", "long")):
        values = {str(r[i]) for r in rows if r[i] is not None}
        assert found[name] == sorted(values, key=lambda v: hashlib.md5(v.encode()).hexdigest())[:4]
    assert found["none"] == []
