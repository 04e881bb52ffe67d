"""JSON arrays of any size, read in parts: records are found by depth and quotes, and become one line each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import scratch_path, write_once


def _outside(text: Column, inside: bool) -> Column:
    """``text`` (without escapes) less what stands between quotes, if it begins outside or inside a string."""
    begun = F.regexp_replace(text, '^[^"]*("|$)', "") if inside else text
    return F.regexp_replace(begun, '"[^"]*("|$)', "")


def _count(text: Column, character: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character)))


def _before(value: str) -> Column:
    """The sum of ``value`` over the chunks of a block before this one."""
    order = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(order), F.lit(0))


def _blocks_before(chunks: DataFrame, value: str, name: str) -> DataFrame:
    """``file, block`` and the sum of ``value`` over the blocks of the file before it; one row per block of a file."""
    order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = chunks.groupBy("file", "block").agg(F.sum(value).alias("total"))
    return sums.select("file", "block", F.coalesce(F.sum("total").over(order), F.lit(0)).alias(name))


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, line``: every record (object) of the top-level arrays of a file or folder, its line ends turned to spaces.

    The files are read as text cut behind each ``}``, which Spark does in parallel blocks. Per chunk it is known how many quotes it
    holds and how far it changes the depth if it begins outside or inside a string; sums over the chunks of a block
    and over the blocks of a file then tell the true state at each chunk. A record ends where the depth is 0 again. Objects
    one after another without an array are read alike; arrays of plain values have no records.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    plain = F.regexp_replace("value", r"\\.", "")
    chunks = raw.withColumn("plain", plain).select(
        "file", "block", "at", "value",
        (_count(F.col("plain"), '"') % 2).alias("turns"),
        _count(_outside(F.col("plain"), False), "{").alias("opens_outside"),
        _count(_outside(F.col("plain"), True), "{").alias("opens_inside"),
    )
    chunks = write_once(chunks)
    state = chunks.join(_blocks_before(chunks, "turns", "turned"), ["file", "block"])
    state = state.withColumn("inside", (_before("turns") + F.col("turned")) % 2 == 1)
    ends_outside = F.col("inside") == (F.col("turns") == 1)  # the } behind the chunk closes an object
    change = F.when(F.col("inside"), F.col("opens_inside")).otherwise(F.col("opens_outside")) - F.when(ends_outside, 1).otherwise(0)
    deep = write_once(state.select("file", "block", "at", "value", change.alias("change")))
    deep = deep.join(_blocks_before(deep, "change", "depth_before"), ["file", "block"])
    depth = _before("change") + F.col("depth_before") + F.col("change")
    # behind the last } there is a rest of the file without a record, which the depth cannot end
    ended = deep.withColumn("depth", depth).withColumn("ends", F.when(F.col("depth") == 0, 1).otherwise(0)).drop("change", "depth_before")
    ended = write_once(ended)
    numbered = ended.join(_blocks_before(ended, "ends", "ended"), ["file", "block"])
    numbered = numbered.withColumn("record", _before("ends") + F.col("ended"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = F.concat(F.array_join(F.transform(parts, lambda p: p["value"]), "}"), F.lit("}"))
    lines = numbered.groupBy("file", "record").agg(joined.alias("line"), F.max("ends").alias("whole")).where("whole = 1")
    begun = F.regexp_replace(F.regexp_replace("line", r"^[^{]*", ""), r"[\r\n]+", " ")
    return lines.select("file", "record", begun.alias("line"))


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The records of JSON arrays as a table with inferred types; they are written once as lines, so that every later pass reads them in parallel."""
    lines = scratch_path(spark, "json-lines")
    records_of(spark, path).select("line").write.text(lines)
    return spark.read.json(lines)
