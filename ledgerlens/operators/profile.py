"""Profiling and data quality. Every figure comes from one aggregate over the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import is_number, is_time, plain_number, to_number, to_time
from ..functions.edge import edge_round, long_count, percent, zero_if_null
from .scale import exact_quantiles, first_per_group, one_row

TYPE_THRESHOLD = 0.8
#: Types of one text a value, those of them that are short, and how many different short values one task may keep of a column.
SHORT = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
ONE_TEXT = (*SHORT, T.StringType)
FEW_SHORT = 4096


def _missing(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def parses_as_number(field: T.StructField, robust: bool = False) -> Column:
    """Non-text columns count as numbers wherever they hold a value."""
    c = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        return ~_missing(field)
    return (to_number(c) if robust else plain_number(F.trim(c))).isNotNull()


def parses_as_date(field: T.StructField, day_first: bool = False) -> Column:
    """Numbers are readable as epoch offsets, so they count wherever they hold a value."""
    if not isinstance(field.dataType, T.StringType):
        return ~_missing(field)
    return to_time(F.col(f"`{field.name}`"), day_first).isNotNull()


def _per_column(df: DataFrame, make, schema: list[str]) -> DataFrame:
    """One aggregate for all columns, turned into one row per column."""
    cells = F.array(*[F.struct(*[e.alias(n) for e, n in zip(make(i, f), schema)]) for i, f in enumerate(df.schema.fields)])
    return df.agg(cells.alias("__c")).select(F.inline("__c"))


def inferred_type(field: T.StructField) -> Column:
    if is_time(field.dataType):
        return F.lit("date")
    if is_number(field.dataType):
        return F.lit("number")
    filled = F.count_if(~_missing(field))
    dates = F.count_if(parses_as_date(field)) / filled
    numbers = F.count_if(parses_as_number(field)) / filled
    return (
        F.when(filled == 0, "text")
        .when((dates >= TYPE_THRESHOLD) & (dates >= numbers), "date")
        .when(numbers >= TYPE_THRESHOLD, "number")
        .otherwise("text")
    )


def infer_types(df: DataFrame) -> DataFrame:
    return _per_column(df, lambda i, f: (F.lit(f.name), inferred_type(f)), ["column", "inferred_type"])


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count, share and inferred type per column."""
    return _per_column(
        df,
        lambda i, f: (
            F.lit(f.name),
            F.count_if(_missing(f)),
            zero_if_null(percent(F.count_if(_missing(f)), long_count())),
            inferred_type(f),
        ),
        ["column", "missing_count", "missing_pct", "inferred_type"],
    )


def top_missing(df: DataFrame, n: int = 5) -> DataFrame:
    return missing_values(df).orderBy(F.col("missing_count").desc(), F.col("column")).limit(n)


def _counted_rows(df: DataFrame) -> DataFrame:
    """Distinct rows with their number; NULLs compare equal, equal rows meet on the map side first."""
    plain = df.select(
        *[
            F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
    return plain.groupBy(*[F.col(f"`{c}`") for c in plain.columns]).agg(long_count().alias("__n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one."""
    return (
        _counted_rows(df)
        .agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .withColumn(
            "duplicate_pct", edge_round(zero_if_null(percent(F.col("duplicate_rows"), F.col("total_rows"))), 2)
        )
    )


def quality_score(df: DataFrame) -> DataFrame:
    """100 - missing % - duplicate %, kept within 0..100, from the shares before they are rounded. One pass serves both parts."""
    missing = reduce(lambda a, b: a + b, [F.when(_missing(f), 1).otherwise(0) for f in df.schema.fields])
    width = len(df.columns)
    shares = _counted_rows(df.withColumn("__missing", missing)).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.lit(width).cast("bigint").alias("column_count"),
        zero_if_null(percent(F.sum(F.col("__missing") * F.col("__n")), F.sum("__n") * width)).alias("missing"),
        zero_if_null(percent(F.sum(F.col("__n") - 1), F.sum("__n"))).alias("duplicate"),
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - F.col("missing") - F.col("duplicate")))
    return shares.select(
        "row_count", "column_count",
        edge_round(F.col("missing"), 2).alias("missing_pct"),
        edge_round(F.col("duplicate"), 2).alias("duplicate_pct"),
        edge_round(score, 2).alias("quality_score"),
    )


def health_snapshot(df: DataFrame) -> dict[str, DataFrame]:
    return {"columns": missing_values(df), "duplicates": duplicate_rows(df)}


def value_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(position, column, value, count) of every distinct value as text, missing values included.

    Repeated values meet on the map side; what follows looks at every value once.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if names is None or f.name in names]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("position"),
                F.lit(f.name).alias("column"),
                F.when(~_missing(f), F.col(f"`{f.name}`").cast("string")).alias("value"),
            )
            for i, f in fields
        ]
    )
    return (
        df.select(F.explode(cells).alias("x")).select("x.*").groupBy("position", "column", "value").agg(long_count().alias("count"))
    )


def distinct_samples(df: DataFrame, k: int = 3) -> DataFrame:
    """``column, samples``: of each column the ``k`` different values (as text, whole) whose MD5 is least, in that order; fewer if it has fewer.

    An estimate of each column's distinct count sets a limit below which about ``16 * k`` of its values fall; only those are
    kept, once each, in one pass over all columns. Columns of few values keep them all, so that no cell of theirs is digested or even made
    a text where its type has one text a value. A column that gives fewer than ``k`` is asked again without a limit, so the answer is exact.
    """
    texts = {f.name: F.when(~_missing(f), F.col(f"`{f.name}`").cast("string")) for f in df.schema.fields}
    held = {f.name: F.col(f"`{f.name}`") if isinstance(f.dataType, ONE_TEXT) else texts[f.name] for f in df.schema.fields}
    kinds = one_row(df.agg(*[F.approx_count_distinct(c).alias(f"`{n}`") for n, c in held.items()]).toDF(*texts))
    none = "g"  # behind every hexadecimal digit
    few = {f.name: max(32 * k, FEW_SHORT if isinstance(f.dataType, SHORT) else 0) for f in df.schema.fields}
    limits = {n: f"{int(min(1.0, 16 * k / d) * 0xFFFFFFFF):08x}" if d > few[n] else none for n, d in kinds.items()}

    def kept(n: str) -> Column:
        return held[n] if limits[n] == none else F.when(F.md5(texts[n].cast("binary")) < limits[n], texts[n])

    def first(values: Column) -> Column:
        marked = F.array_sort(F.transform(values, lambda v: F.struct(F.md5(v.cast("string").cast("binary")).alias("mark"), v.cast("string").alias("value"))))
        return F.transform(F.slice(marked, 1, k), lambda m: m["value"])

    def least(names: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("column"), texts[n].alias("value"), F.md5(texts[n].cast("binary")).alias("mark")) for n in names]
        below = [F.when(texts[n].isNotNull(), c) for n, c in zip(names, cells)]
        each = df.select(F.explode(F.array_compact(F.array(*below))).alias("c")).select("c.*").distinct()
        first = first_per_group(each, ["column"], [F.col("mark")], k, "place")
        marked = F.array_sort(F.collect_list(F.struct("place", "value")))
        return first.groupBy("column").agg(F.transform(marked, lambda m: m["value"]).alias("samples"))

    sets = df.agg(*[F.collect_set(kept(n)).alias(f"c{i}") for i, n in enumerate(texts)])
    found = dict(zip(texts, sets.select(*[first(F.col(c)).alias(c) for c in sets.columns]).first()))  # k values a column
    short = [n for n in texts if limits[n] != none and len(found[n]) < k]
    if short:
        found |= {r["column"]: r["samples"] for r in least(short).collect()}
    return df.sparkSession.createDataFrame([(n, found.get(n, [])) for n in texts], "column string, samples array<string>")


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """dtype, nulls, distinct values, sample values and parse rates per column.

    Exact profiles shuffle the distinct values of every column and parse each
    of them once. ``exact=False`` is one pass with fixed-size sketches.
    """
    if exact:
        return _exact_profile(df)

    def cells(i, f):
        held = F.when(~_missing(f), F.col(f"`{f.name}`"))
        return (
            F.lit(i).cast("bigint"),
            F.lit(f.name),
            F.lit(f.dataType.simpleString()),
            F.count_if(_missing(f)),
            edge_round(zero_if_null(percent(F.count_if(_missing(f)), long_count())), 2),
            F.approx_count_distinct(held),
            edge_round(zero_if_null(percent(F.count_if(parses_as_date(f)), long_count())), 2),
            edge_round(zero_if_null(percent(F.count_if(parses_as_number(f)), long_count())), 2),
        )

    sketched = _per_column(df, cells, [c for c in PROFILE_FIELDS if c != "samples"])
    return sketched.join(distinct_samples(df), "column").select(*PROFILE_FIELDS)


PROFILE_FIELDS = [
    "position", "column", "dtype", "null_count", "null_pct", "unique_count", "samples", "date_parse_pct", "numeric_parse_pct",
]


def _exact_profile(df: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    value, n = F.col("value"), F.col("count")
    text = kinds[F.col("column")] == "string"
    held = value.isNotNull()
    judged = value_counts(df).select(
        "position", "column", "value", "count",
        F.when(text, to_time(value).isNotNull()).otherwise(held).alias("date"),
        F.when(text, plain_number(F.trim(value)).isNotNull()).otherwise(held).alias("number"),
    )

    def share(flag: Column) -> Column:
        return edge_round(zero_if_null(percent(F.sum(F.when(flag, n).otherwise(0)), F.sum(n))), 2)

    return judged.groupBy("position", "column").agg(
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("null_count"),
        share(value.isNull()).alias("null_pct"),
        F.count(value).alias("unique_count"),
        share(F.col("date")).alias("date_parse_pct"),
        share(F.col("number")).alias("numeric_parse_pct"),
    ).join(distinct_samples(df), "column").select("position", "column", kinds[F.col("column")].alias("dtype"), *PROFILE_FIELDS[3:])


def numeric_summary(df: DataFrame, first: int = 8) -> DataFrame:
    """Count, mean, min, max, std of the first numeric columns."""
    fields = [f for f in df.schema.fields if is_number(f.dataType)][:first]
    numeric = df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) for f in fields])
    return _per_column(
        numeric,
        lambda i, f: (
            F.lit(f.name), F.count(f"`{f.name}`"), F.avg(f"`{f.name}`"), F.min(f"`{f.name}`"), F.max(f"`{f.name}`"),
            F.stddev_samp(f"`{f.name}`"),
        ),
        ["column", "count", "mean", "min", "max", "std"],
    )


def top_values(df: DataFrame, first: int = 8, n: int = 5) -> DataFrame:
    """Most frequent values of the first non-numeric columns."""
    names = [f.name for f in df.schema.fields if not is_number(f.dataType)][:first]
    counted = value_counts(df, names).where(F.col("value").isNotNull()).select("column", "value", "count")
    return first_per_group(counted, ["column"], [F.col("count").desc(), F.col("value")], n, "position").withColumn(
        "position", F.col("position").cast("bigint")
    )


def exploratory_summary(df: DataFrame) -> dict[str, DataFrame]:
    missing = missing_values(df).select("column", edge_round(F.col("missing_pct"), 2).alias("missing_pct"))
    return {
        "missing": missing.orderBy(F.col("missing_pct").desc(), F.col("column")).limit(10),
        "numeric": numeric_summary(df),
        "top_values": top_values(df),
    }


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max of one column."""
    x = F.col(column).cast("double")
    quart = one_row(exact_quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75}))
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"),
    ).select(F.lit(column).alias("column"), "*", *[F.lit(v).cast("double").alias(k) for k, v in quart.items()])


def shape(df: DataFrame) -> DataFrame:
    return df.agg(long_count().alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), F.lit(", ".join(df.columns)).alias("names")
    )


def filter_values(df: DataFrame, dim: str = "product_category", date: str = "date") -> DataFrame:
    """Distinct members of a dimension with their date range."""
    return df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(
        F.to_date(F.min(date)).alias("min_date"), F.to_date(F.max(date)).alias("max_date")
    )


def groupable(df: DataFrame, dims: list[str], at_least: int = 2) -> DataFrame:
    """Does a dimension hold enough distinct values for a chart?"""
    counted = df.agg(F.array(*[F.struct(F.lit(d).alias("dimension"), F.count_distinct(d).alias("members")) for d in dims]).alias("c"))
    return counted.select(F.inline("c")).withColumn("groupable", F.col("members") >= at_least)
