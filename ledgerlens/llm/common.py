"""Frames every operator of this package starts from, and ordered running totals without one big task."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, write_once

__all__ = ["read", "texts", "running_totals", "shuffle_partitions", "rows_per_batch", "bytes_per_batch", "scratch_path", "write_once"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long), the text (null: empty) and the columns named in ``more``.

    Every other column of the input is dropped here, so its name cannot clash with one an operator adds.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in more],
    )


def shuffle_partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_totals(df: DataFrame, order: list, totals: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``new: column`` of ``totals``, the sum of the column over all rows up to this one.

    Rows are range-sorted on ``order``; each range adds up its own rows, and only one row per range (as many as
    there are shuffle partitions) meets in one task for the offsets. The sorted table is written once, because both
    passes must see the same ranges. ``order`` should end in a column that tells rows apart, so that no value of
    the leading columns has to fit into one range. ``df`` must have no column ``_range`` or ``_at``.
    """
    ranged = df.repartitionByRange(shuffle_partitions(df), *order).withColumn("_range", F.spark_partition_id())
    ranged = write_once(ranged)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(new) for new, c in totals.items()])
    starts = sums.select("_range", *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"_at_{new}") for new in totals])
    out = ranged.withColumns({new: F.sum(c).over(within) for new, c in totals.items()})
    out = out.join(F.broadcast(starts), "_range")  # one row per range
    return out.select(*df.columns, *[(F.col(new) + F.col(f"_at_{new}")).alias(new) for new in totals])


@contextmanager
def _held(spark: SparkSession, name: str, value: object):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rows_per_batch(spark: SparkSession, rows: int):
    """Within this block Arrow batches hold at most ``rows`` rows: for tables whose rows are large, so that a batch is not a whole file."""
    return _held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bytes_per_batch(spark: SparkSession, size: int):
    """Within this block Arrow batches end at the row that reaches ``size`` bytes: for whole texts, of which the default 10 000 may be hundreds of megabytes."""
    return _held(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b``), the label being the least node of its component.

    Alternates the large-star and small-star steps of Kiveris et al. until the edges no longer change: each step joins
    the edges with one row per node, so a hub's edges are an ordinary skewed join. Every step's edges are written to the
    shared folder, which also cuts the lineage.
    """

    def star(both: DataFrame, larger: bool) -> DataFrame:
        least = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
        near = both.filter("b > a") if larger else both.filter("b < a")
        moved = near.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = write_once(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        spread = write_once(star(both_ways(edges), True))
        edges = write_once(star(spread.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
