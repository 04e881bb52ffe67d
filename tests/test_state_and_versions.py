"""Streams in bounded state, tables folded into versions, pairs counted in ranges."""

from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import products
from ledgerlens.sources import sinks
from ledgerlens.streaming import live


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    df.coalesce(1).write.mode("append").parquet(folder)


def hundred_days(spark, folder):
    """100 daily windows, five new ones a file; every file also brings a row two days late, and the last a row 60 days late."""
    rng = np.random.default_rng(4)
    rows, begin = [], datetime(2024, 1, 1, 12)
    for step in range(20):
        new = [(begin + timedelta(days=5 * step + d, hours=int(h)), float(v)) for d in range(5) for h, v in zip(rng.integers(-11, 11, 6), rng.integers(1, 99, 6))]
        late = [(begin + timedelta(days=5 * step - 2), 1000.0)] if step else []
        arrive(spark, folder, new + late)
        rows += new + late
    arrive(spark, folder, [(begin + timedelta(days=40), 1e6)])  # its window is closed: left out
    return rows


def batch_totals(rows):
    totals = Counter()
    for ts, value in rows:
        totals[ts.date()] += value
    return totals


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_kpis_in_bounded_state(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    rows = hundred_days(spark, folder)
    stream = live.windowed_kpis(live.event_stream(spark, folder, per_trigger=1), lateness="3 days")
    query = live.start_windows(stream, live.KPIS, table, state)
    query.awaitTermination()
    held = state_rows(query)
    assert len(held) > 20 and max(held) <= 15  # of 100 windows
    found = {r.window_start: r.total_value for r in live.window_table(spark, table, live.KPIS).read().collect()}
    assert found == dict(batch_totals(rows))


def test_alerts_in_bounded_state(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    rows = hundred_days(spark, folder)
    stream = live.window_alerts(live.event_stream(spark, folder, per_trigger=1), lateness="3 days")
    query = live.start_windows(stream, live.ALERTS, table, state)
    query.awaitTermination()
    held = state_rows(query)
    assert max(held) <= 20
    totals = batch_totals(rows)
    before, wanted = None, {}
    for day in sorted(totals):
        change = None if before is None else 100.0 * (totals[day] - before) / before
        wanted[day] = (totals[day], change, "normal" if change is None or -20 <= change <= 20 else "spike" if change > 20 else "drop")
        before = totals[day]
    found = {r.window_start: (r.total_value, r.change_pct, r.alert) for r in live.window_table(spark, table, live.ALERTS).read().collect()}
    assert found == wanted


def test_late_rows_correct_the_alert_behind_them(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))

    def refresh():
        out = live.refresh_alerts(live.event_stream(spark, folder), table=table, state=state)
        return {str(r.window_start): (r.total_value, r.change_pct, r.alert) for r in out.collect()}

    arrive(spark, folder, [(datetime(2024, 1, 1, 9), 10.0), (datetime(2024, 1, 2, 9), 11.0)])
    assert refresh() == {"2024-01-01": (10.0, None, "normal"), "2024-01-02": (11.0, 10.0, "normal")}
    arrive(spark, folder, [(datetime(2024, 1, 1, 23), 10.0), (datetime(2024, 1, 4), None)])
    assert refresh() == {"2024-01-01": (20.0, None, "normal"), "2024-01-02": (11.0, -45.0, "drop"), "2024-01-04": (None, None, "normal")}


def test_a_thousand_runs_become_five(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(1000).select(F.lit("u").alias("user"), F.col("id").alias("analyzed_at"))
    runs = sinks.run_history(spark, path, rows.schema)
    for k in range(20):
        runs.append(rows.where(F.col("id") % 20 == k))
        if k % 6 == 5:
            runs.compact()
    assert runs.pending() == 2
    runs.compact()
    version, held = runs._newest()
    assert spark.read.parquet(f"{path}/versions/{version}/rows").count() == 5 and runs.pending() == 0
    assert sorted(r.analyzed_at for r in runs.read().collect()) == [995, 996, 997, 998, 999]
    assert len(runs._complete("versions", "folded/_SUCCESS")) == 2 and len(runs._complete("log")) <= 8


def test_readers_during_a_compaction_see_a_whole_version(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.range(40).select((F.col("id") % 4).cast("string").alias("user"), F.col("id").alias("analyzed_at"))
    runs = sinks.run_history(spark, path, rows.schema, keep=2)
    runs.append(rows.where("id < 20"))
    runs.compact()
    runs.append(rows.where("id >= 20"))
    early = runs.read()  # chose its version and entries before the compaction
    half = runs.spark.read.schema(rows.schema).parquet(f"{path}/log/{runs._complete('log')[-1]}")
    half.write.parquet(f"{path}/versions/0000000002-half/rows")  # a version without its list, as a stopped compaction leaves it
    wanted = [(str(k % 4), k) for k in range(32, 40)]

    def seen(df):
        return sorted((r.user, r.analyzed_at) for r in df.collect())

    assert seen(runs.read()) == sorted(wanted)
    runs.compact()
    assert seen(early) == seen(runs.read()) == sorted(wanted)
    runs.compact()  # nothing new
    assert seen(runs.read()) == sorted(wanted)


def test_an_entry_written_again_counts_once(spark, tmp_path):
    windows = live.window_table(spark, str(tmp_path / "w"), live.ALERTS)
    row = spark.createDataFrame([(date(2024, 1, 1), 1.0, None, "normal", 0)], windows.schema)
    windows.append(row, "000000000000")
    windows.append(row, "000000000000")
    windows.append(row.withColumns({"total_value": F.lit(2.0), "batch": F.lit(1).cast("bigint")}), "000000000001")
    windows.compact()
    assert [r.total_value for r in windows.read().collect()] == [2.0]


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_pairs_by_ranges(spark, width):
    """A basket that holds every item, many equal ones, and a few others."""
    rng = np.random.default_rng(6)
    baskets = {0: set(range(120))} | {k: {1, 2, 3} for k in range(1, 30)} | {k: set(rng.integers(0, 120, 9).tolist()) for k in range(30, 60)}
    df = spark.createDataFrame([(b, f"i{i:03d}") for b, own in baskets.items() for i in own], "basket long, item string")
    wanted = Counter((f"i{a:03d}", f"i{b:03d}") for own in baskets.values() for a in own for b in own if a < b)
    found = products.pair_counts(df, df.select("item").distinct(), width).collect()
    assert {(r.product_a, r.product_b): r.co_purchase_count for r in found} == dict(wanted)


def test_a_basket_of_many_frequent_items(spark):
    """4 000 items in one basket: eight million pairs, from rows of at most two ranges."""
    df = spark.range(4000).select(F.lit(1).alias("basket"), F.format_string("i%05d", "id").alias("item"))
    found = products.pair_counts(df, df.select("item"))
    assert found.agg(F.count("*"), F.sum("co_purchase_count"), F.count_if(F.col("product_a") >= F.col("product_b"))).first()[:] == (7998000, 7998000, 0)
