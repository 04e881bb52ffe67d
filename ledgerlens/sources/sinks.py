"""Writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scale import first_per_group
from .versions import FoldedTable


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sections(sections: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One sub-folder per result."""
    for name, df in sections.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else getattr(writer, fmt))(f"{folder.rstrip('/')}/{name}")


def long_form(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, key, value) rows of small results; the key is the column name."""
    parts = []
    for name, df in sections.items():
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
        parts.append(text.unpivot([], text.columns, "key", "value").select(F.lit(name).alias("section"), "key", "value"))
    return reduce(DataFrame.unionByName, parts)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, times become ISO texts."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(c)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def loose_json(df: DataFrame, column: str, schema: T.StructType | str, name: str = "parsed") -> DataFrame:
    """``df`` with the JSON texts of a column parsed as far as they go: a text that is no JSON gives a row of nulls, a field of
    another type a null field; single quotes, bare names, comments and NaN or Infinity are let pass."""
    options = {
        "mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true",
        "allowNonNumericNumbers": "true", "allowComments": "true",
    }
    return df.withColumn(name, F.from_json(F.col(f"`{column}`"), schema, options))


def write_json(df: DataFrame, path: str) -> None:
    json_safe(df).write.mode("overwrite").json(path)


def data_dictionary(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), "") for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, description string")


def flatten(df: DataFrame, depth: int = 2) -> DataFrame:
    """Nested result rows to (key, value): structs by dotted name, arrays of structs by position, two levels deep."""
    pairs = F.concat(*[_pairs(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), depth) for f in df.schema.fields])
    return df.select(F.explode(pairs).alias("p")).select("p.key", "p.value")


def _pairs(c: Column, kind: T.DataType, key: Column, depth: int) -> Column:
    if depth > 0 and isinstance(kind, T.StructType):
        return F.concat(
            *[_pairs(c.getField(f.name), f.dataType, F.concat(key, F.lit("." + f.name)), depth - 1) for f in kind.fields]
        )
    if depth > 0 and isinstance(kind, T.ArrayType):
        return F.flatten(
            F.transform(
                F.coalesce(c, F.array().cast(kind)),
                lambda x, i: _pairs(x, kind.elementType, F.concat(key, F.lit("["), i.cast("string"), F.lit("]")), depth - 1),
            )
        )
    text = F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
    return F.array(F.struct(key.alias("key"), text.alias("value")))


# ---- run history ----


def append_run(df: DataFrame, path: str) -> None:
    """Append summary rows (user, analyzed_at, ...) to a plain table, which grows with every run; ``run_history`` does not."""
    df.write.mode("append").parquet(path)


def recent_runs(history: DataFrame, keep: int = 5, ties: tuple[str, ...] = ()) -> DataFrame:
    """The newest runs of every user."""
    order = [F.col("analyzed_at").desc(), *[F.col(c) for c in ties]]
    return first_per_group(history, ["user"], order, keep, "position").withColumn("position", F.col("position").cast("bigint"))


def run_history(spark: SparkSession, path: str, schema: T.StructType, keep: int = 5, ties: tuple[str, ...] = ()) -> FoldedTable:
    """The history of runs as a table that keeps ``keep`` runs of a user: append runs to it, read it at any time, compact it now and then."""
    return FoldedTable(spark, path, schema, lambda runs: recent_runs(runs, keep, ties).drop("position"))


def report_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.col("created_at").desc())
