"""Live KPI refresh and alerts with Structured Streaming, in state that the watermark bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.edge import long_count
from ..session import scratch_path
from ..sources.versions import FoldedTable

LATENESS = "7 days"
#: Batches after which the written windows are folded into one version.
FOLD_EVERY = 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KPIS = "window_start date, events long, total_value double, average_value double, max_value double"
ALERTS = "window_start date, total_value double, change_pct double, alert string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as a stream; the schema comes from the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def windowed_kpis(events: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Total, count, mean and largest value per window. The watermark closes a window ``lateness`` after its end: its state goes,
    and rows that come later still are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(
            long_count().alias("events"),
            F.sum("value").alias("total_value"),
            F.avg("value").alias("average_value"),
            F.max("value").alias("max_value"),
        )
        .select(F.to_date("w.start").alias("window_start"), "events", "total_value", "average_value", "max_value")
    )


class WindowAlerts(StatefulProcessor):
    """Change of each window's total against the window before it.

    The state of a key holds the totals of its open windows and the last closed one. A batch gives out the windows that it
    touched and the ones behind them, whose change it altered.
    """

    def __init__(self, threshold: float, width_ms: int):
        self.threshold, self.width_ms = threshold, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "start long", "total double")
        self.closed = handle.getValueState("closed", "start long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timers.getCurrentWatermarkInMs()
        totals = {k[0]: v[0] for k, v in self.open.iterator()}
        last = self.closed.get() if self.closed.exists() else None
        touched = set()
        for part in rows:
            for start, total in zip(part["start"].tolist(), part["total"].tolist()):
                if start + self.width_ms > watermark:
                    old = totals.get(start)
                    totals[start] = total if old is None or pd.isna(old) else old if pd.isna(total) else old + total
                    touched.add(start)
        before, out, altered = last, [], False
        for start in sorted(totals):
            if start in touched or altered:
                out.append((start, totals[start], before[1] if before else None))
            altered = start in touched
            before = (start, totals[start])
        for start in sorted(totals):
            if start + self.width_ms <= watermark:
                self.closed.update((start, totals[start]))
                if self.open.containsKey((start,)):
                    self.open.removeKey((start,))
            elif start in touched:
                self.open.updateValue((start,), (totals[start],))
        yield pd.DataFrame(out, columns=["start", "total", "before"]).astype({"start": "int64", "total": "float64", "before": "float64"})

    def close(self) -> None:
        pass


def window_alerts(events: DataFrame, window: str = "1 day", threshold: float = 20.0, lateness: str = LATENESS) -> DataFrame:
    """``window_start, total_value, change_pct, alert`` (spike, drop or normal) of the windows that a batch touches or alters.

    Each task first sums its rows per window, so the one key that sees all windows gets a row per task and window.
    """
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    started = own.select("ts", "value", F.window("ts", window).alias("w"))
    parts = started.select("ts", "value", F.unix_millis("w.start").alias("start"), F.unix_millis("w.end").alias("end")).where(F.col("ts").isNotNull())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grouped = batch.groupby("start", as_index=False).agg(ts=("ts", "max"), total=("value", lambda v: v.sum(min_count=1)))
            yield grouped[["ts", "start", "total"]]

    summed = parts.mapInPandas(sums, "ts timestamp, start long, total double").withWatermark("ts", lateness)
    spark = events.sparkSession
    width = spark.range(1).select(F.window(F.lit("2000-01-03").cast("timestamp"), window).alias("w"))
    width = width.select(F.unix_millis("w.end") - F.unix_millis("w.start")).first()[0]
    found = summed.withColumn("key", F.lit(0)).groupBy("key").transformWithStateInPandas(
        WindowAlerts(threshold, width), "start long, total double, before double", outputMode="Update", timeMode="EventTime"
    )
    before = F.nullif(F.nanvl("before", F.lit(0.0)), F.lit(0.0))
    total = F.nanvl("total", F.lit(None).cast("double"))
    change = 100.0 * (total - before) / before
    alert = F.when(change > threshold, "spike").when(change < -threshold, "drop").otherwise("normal")
    return found.select(F.to_date(F.timestamp_millis("start")).alias("window_start"), total.alias("total_value"), change.alias("change_pct"), alert.alias("alert"))


def _newest_windows(rows: DataFrame) -> DataFrame:
    """Of each window what the latest batch wrote."""
    latest = F.max_by(F.struct("*"), "batch").alias("r")
    return rows.groupBy("window_start").agg(latest).select("r.*")


def window_table(spark: SparkSession, path: str, columns: str) -> FoldedTable:
    """The table of windows at ``path``; ``columns`` is ``KPIS`` or ``ALERTS``."""
    schema = T.StructType([*T._parse_datatype_string(columns).fields, T.StructField("batch", T.LongType())])
    return FoldedTable(spark, path, schema, _newest_windows)


def start_windows(stream: DataFrame, columns: str, table: str, state: str) -> StreamingQuery:
    """Process all files present, then stop. Every batch appends the windows that changed, in an entry of its own number that appears
    whole or not at all; now and then entries are folded, so the table has a row per window and few files."""
    spark = stream.sparkSession
    windows = window_table(spark, table, columns)

    def publish(batch: DataFrame, epoch: int) -> None:
        windows.append(batch.withColumn("batch", F.lit(epoch).cast("bigint")), f"{epoch:012d}")
        if epoch % FOLD_EVERY == FOLD_EVERY - 1:
            windows.compact()

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        return (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .foreachBatch(publish)
            .start()
        )
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def _run_to_table(stream: DataFrame, columns: str, label: str, table: str | None, state: str | None) -> DataFrame:
    """The table of windows after all files present.

    ``table`` and ``state`` are given together or not at all. With fixed paths the next call (or a restart after a
    failure) goes on where the last one stopped, and a call without new files returns the last result; by default both are
    new folders in the shared scratch space.
    """
    if (table is None) != (state is None):
        raise ValueError("give table and state together")
    spark = stream.sparkSession
    target = table or scratch_path(spark, label)
    start_windows(stream, columns, target, state or scratch_path(spark, label + "-state")).awaitTermination()
    return window_table(spark, target, columns).read().drop("batch")


def refresh_kpis(
    events: DataFrame, window: str = "1 day", table: str | None = None, state: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    return _run_to_table(windowed_kpis(events, window, lateness), KPIS, "live-kpis", table, state)


def refresh_alerts(
    events: DataFrame, window: str = "1 day", threshold: float = 20.0, table: str | None = None, state: str | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    return _run_to_table(window_alerts(events, window, threshold, lateness), ALERTS, "live-alerts", table, state)
