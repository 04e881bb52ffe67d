"""Schema discovery, validation and capability gates."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import mapping
from ledgerlens.plans import analysis
from ledgerlens.plans.spec import map_metric, run_query
from ledgerlens.sources import readers


def _canonical(full_mode):
    return full_mode.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def test_clean_table_has_no_issues(full_mode):
    df = _canonical(full_mode)
    assert mapping.mapping_issues(df).count() == 0
    assert mapping.mapping_confidence(df) == "HIGH"
    data = analysis.ingest_frame(df)
    assert (data.mode, data.confidence, data.frame.count()) == ("full_analytics", "HIGH", 6)
    assert {"date", "total_amount", "customer_id", "product_category"} <= set(data.mapped)


def test_salary_is_not_an_amount(spark):
    df = spark.createDataFrame(
        [("Ana", "HR", 50000, "2021-01-01"), ("Bo", "IT", 60000, "2021-02-01"), ("Cy", "IT", 61000, "2021-03-01"), ("Di", "HR", 52000, "2021-04-01")],
        "employee_name string, department string, salary bigint, join_date string",
    )
    assert "total_amount" not in mapping.auto_map(df)
    assert analysis.ingest_frame(df).mode == "exploratory_only"


def test_bad_customer_mapping_is_low(spark):
    rows = [(f"2024-01-{i:02d}", 100 + i, f"S{i % 3}", "A" if i % 2 else "B") for i in range(1, 11)]
    raw = spark.createDataFrame(rows, "order_date string, sales_amount bigint, segment string, discount_bucket string")
    chosen = {"date": "order_date", "total_amount": "sales_amount", "customer_id": "discount_bucket", "product_category": "segment"}
    frame = mapping.apply_manual_mapping(raw, chosen)
    issues = [r["issue"] for r in mapping.mapping_issues(frame).collect()]
    assert any("Customer ID mapping is suspicious" in i for i in issues)
    assert mapping.mapping_confidence(frame) == "LOW"


def test_manual_mapping_errors(spark):
    raw = spark.createDataFrame([("2024-01-01", 1.0)], "d string, a double")
    with pytest.raises(ValueError, match="total_amount"):
        mapping.apply_manual_mapping(raw, {"date": "d"})
    with pytest.raises(ValueError, match="not found"):
        mapping.apply_manual_mapping(raw, {"date": "d", "total_amount": "x"})


def test_currency_file(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "txn_ref,purchase_ts,gross_sales,zone,category\n"
        "T1,2025-01-05 10:00:00,$120.50,North,Toys\nT2,2025-01-06 11:00:00,$80.00,South,Books\n"
        'T3,2025-01-07 12:00:00,"$1,310.25",North,Toys\nT4,2025-01-08 13:00:00,$99.99,East,Home\nT5,2025-01-09 14:00:00,$45.10,West,Books\n'
    )
    data = analysis.ingest(spark, str(path))
    assert data.mapped["total_amount"] == "gross_sales" and data.mapped["date"] == "purchase_ts"
    assert round(data.frame.agg(F.sum("total_amount")).first()[0], 2) == 1655.84


def test_day_first_json(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(
        '[{"client_code":"K1","ordered_on":"03/02/2025","order_total":"1,250.00","country":"IN","item_group":"A"},'
        '{"client_code":"K2","ordered_on":"14/02/2025","order_total":"980.50","country":"IN","item_group":"B"},'
        '{"client_code":"K1","ordered_on":"28/02/2025","order_total":"310.00","country":"US","item_group":"A"}]'
    )
    data = analysis.ingest(spark, str(path))
    assert data.mapped["date"] == "ordered_on"
    assert [str(r[0]) for r in data.frame.select(F.to_date("date")).orderBy(F.col("date")).collect()] == ["2025-02-03", "2025-02-14", "2025-02-28"]


def test_detectors(spark):
    rows = [(f"T{i}", f"2024-02-{i % 28 + 1:02d}", "Jo Doe", i * 2.5, f"c{i % 7}", "North" if i % 2 else "South") for i in range(1, 21)]
    df = spark.createDataFrame(rows, "ref string, sale_day string, Sales_Rep string, sales_value double, client string, area string")
    facts = mapping.column_facts(df)
    assert mapping.detect("date", facts) == "sale_day"
    assert mapping.detect("amount", facts) == "sales_value"
    assert mapping.detect("region", facts) == "area"
    assert mapping.detect("customer", facts) == "client"


def test_candidates_and_remap(full_mode):
    df = _canonical(full_mode).withColumnsRenamed({"date": "order_date", "total_amount": "sales_amount"})
    rows = mapping.mapping_candidates(df).collect()
    assert max(r["rank"] for r in rows) == 3
    best = {r["role"]: r["column"] for r in rows if r["rank"] == 1}
    assert best["date"] == "order_date" and best["total_amount"] == "sales_amount"
    assert mapping.auto_remap(df)["date"] == "order_date"
    with pytest.raises(ValueError):
        mapping.auto_remap(df.select("product_category"))


def test_capabilities_and_mode():
    able = mapping.capabilities(["date", "total_amount"])
    assert able["kpis"] and not able["segmentation"]
    assert mapping.analysis_mode(able) == "partial_analytics"
    assert mapping.analysis_mode(mapping.capabilities(["x"])) == "exploratory_only"
    assert mapping.suggested_questions({}) == ["Which columns hold date and amount?"]


def test_gates_skip_with_reason(spark, full_mode):
    run = analysis.run_basic(full_mode.select("date", "total_amount"))
    status = {r.step: r for r in run.status_frame(spark).collect()}
    assert status["segmentation"].status == "skipped" and status["segmentation"].missing_columns == ["customer_id"]
    assert status["kpis"].status == "completed"
    picked = analysis.run_advanced(full_mode, ["CLV", "Sales Forecast", "geographic"])
    state = {s[0]: s[1] for s in picked.status}
    assert state == {"clv": "completed", "forecast": "completed", "geographic": "skipped"}


def test_question_columns():
    columns = ["Order ID", "Total Amount", "Product Category", "Age"]
    assert mapping.best_column_for("average age of buyers", columns) == "Age"
    assert mapping.best_column_for("zzz", columns) is None
    assert mapping.metric_column_for("what is total revenue", columns, ["Age", "Total Amount"]) == "Total Amount"
    assert mapping.contains_phrase("top categories", "category") and not mapping.contains_phrase("catalogue", "cat")


def test_specs(full_mode):
    top = run_query(full_mode, {"intent": "ranking_query", "metric": "revenue", "group_by": "product_category", "top_n": 2})
    assert [r.product_category for r in top.collect()] == ["Electronics", "Beauty"]
    low = run_query(full_mode, {"intent": "ranking_query", "metric": "sales", "group_by": "product_category", "order": "asc"})
    assert [r.product_category for r in low.collect()][0] == "Grocery" and low.count() == 4
    recent = run_query(full_mode, {"metric": "amount", "group_by": "customer_id", "time": 14, "filters": {"product_category": ["Beauty", "Home"]}})
    assert {r.customer_id for r in recent.collect()} == {"C4", "C5"}
    with pytest.raises(ValueError):
        run_query(full_mode, {"group_by": "x"})
    with pytest.raises(ValueError):
        map_metric("speed", ["sales"])
    assert map_metric("profit", ["profit", "total_amount"]) == "profit"


def test_reader_rejects_unknown(spark):
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "/tmp/x.xml")


def test_bom_and_spaces(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_bytes("﻿Date,Total Amount\n2024-01-01,5\n".encode())
    assert readers.read_dataset(spark, str(path)).columns == ["Date", "Total Amount"]


def test_training_union(spark):
    a = spark.createDataFrame([("id ", "1|2", "int", "Customer ID"), ("", "x", "t", "y")], "column_name string, sample_values string, dtype string, label string")
    assert readers.union_training([a, a]).count() == 1
    with pytest.raises(ValueError):
        readers.union_training([a.drop("label")])


@pytest.mark.parametrize("ratio", [0.196, 0.197, 0.198, 0.199, 0.200, 0.201])
def test_uniqueness_is_exact_near_its_limit(spark, ratio):
    rows = 50_000
    ids = spark.range(rows).selectExpr(f"concat('customer ', id % {round(rows * ratio)}) AS customer_id", "id * 1.5 AS total_amount", "date '2024-01-01' + int(id % 300) AS date", "concat('c', id % 9) AS product_category")
    facts = mapping.column_facts(ids)
    assert facts["customer_id"]["distinct_filled"] == round(rows * ratio)
    assert mapping.mapping_confidence(ids, facts) == ("LOW" if ratio <= 0.2 else "MEDIUM")


def test_samples_are_the_least_digests_without_a_row_per_cell(spark, monkeypatch):
    import hashlib

    from pyspark.sql import functions as F

    from ledgerlens.operators import profile

    def no_rows(*_):
        raise AssertionError("cells became rows")

    df = spark.range(20_000).select(
        "id", (F.col("id") % 3000).alias("some"), F.when(F.col("id") % 2 == 0, F.col("id") % 5).cast("string").alias("few"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 700).cast("int")).alias("day"),
        F.concat(F.lit("word "), "id").alias("many"), (F.col("id") % 2 == 0).alias("flag"), F.array(F.col("id") % 200).alias("list"),
    )
    monkeypatch.setattr(profile.F, "explode", no_rows)
    found = {r["column"]: r["samples"] for r in profile.distinct_samples(df).collect()}
    texts = [r.asDict() for r in df.select(*[F.col(c).cast("string") for c in df.columns]).collect()]
    for c in df.columns:
        values = {t[c] for t in texts} - {None}
        assert found[c] == sorted(values, key=lambda v: hashlib.md5(v.encode()).hexdigest())[:3], c
