"""Reading tables of unknown origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import is_time, to_time
from ..operators.clean import pick_column
from .json_arrays import read_json_arrays

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
#: UTF-16 byte-order marks as Latin-1 reads them, and the code points that Windows-1252 has where Latin-1 has controls.
UTF_16_MARKS = ("\xff\xfe", "\xfe\xff")
WINDOWS_TABLE = {b: ord(bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")}
# A strict pattern for type inference: without one, short codes such as "T1" pass as times of day.
TIMESTAMPS = "yyyy-MM-dd[' ']['T']HH:mm:ss[.SSS][XXX]"


def format_of(path: str) -> str:
    for ending, fmt in FORMATS.items():
        if path.rstrip("/").lower().endswith(ending):
            return fmt
    raise ValueError(f"unsupported file format: {path}")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Header plus inferred types (one extra pass; give a schema to save it).

    Without an encoding the file is read byte by byte as Latin-1, which loses nothing, and one pass over the texts decides
    what the bytes are: UTF-8 if all of them are valid, else Windows-1252 if any byte is a control character in
    Latin-1, else Latin-1. The same rows are then decoded. A byte-order mark is left out; UTF-16 needs one.
    """

    def load(enc: str, **options) -> DataFrame:
        reader = spark.read.options(header=True, encoding=enc, timestampFormat=TIMESTAMPS, **options)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)

    if encoding:
        return load(encoding)
    df = load("ISO-8859-1")
    if df.columns and df.columns[0].startswith(UTF_16_MARKS):
        return load("UTF-16", multiLine=True)
    return _decoded(df, _encoding_of(df, schema is None), schema is None)


def _encoding_of(df: DataFrame, read_names: bool) -> str:
    """What the texts of a table, read as Latin-1, and the names of its columns (if they were read too) are encoded in."""
    texts = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = "".join(df.columns) if read_names else ""
    valid, controls = _valid_utf8(names), any("\x80" <= c <= "\x9f" for c in names)
    if texts:
        utf8 = [F.bool_and(F.is_valid_utf8(F.encode(c, "ISO-8859-1").cast("string"))) for c in texts]
        c1 = [F.bool_or(c.rlike("[\\x80-\\x9f]")) for c in texts]
        row = df.agg(F.array(*utf8).alias("utf8"), F.array(*c1).alias("c1")).first()
        valid, controls = valid and all(v is not False for v in row["utf8"]), controls or any(row["c1"])
    return "UTF-8" if valid else "windows-1252" if controls else "ISO-8859-1"


def _valid_utf8(text: str) -> bool:
    try:
        text.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return False
    return True


def _decoded(df: DataFrame, encoding: str, read_names: bool) -> DataFrame:
    """A table read as Latin-1 with its texts and names in their true encoding."""

    def name_of(name: str) -> str:
        if not read_names:
            return name
        return name.encode("latin-1").decode("utf-8") if encoding == "UTF-8" else name.translate(WINDOWS_TABLE) if encoding == "windows-1252" else name

    def text_of(c: Column) -> Column:
        if encoding == "UTF-8":
            return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
        return F.translate(c, "".join(map(chr, WINDOWS_TABLE)), "".join(map(chr, WINDOWS_TABLE.values()))) if encoding == "windows-1252" else c

    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((text_of(c) if isinstance(f.dataType, T.StringType) else c).alias(name_of(f.name).lstrip("\ufeff")))
    return df.select(*out)


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """CSV, JSON (array of records, or one record per line with ``lines=True``) or Parquet, by ending or by name."""
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return read_csv(spark, path, options.get("encoding"), options.get("schema"))
    if fmt == "json":
        return spark.read.json(path) if options.get("lines", False) else read_json_arrays(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {fmt}")


def with_dates(df: DataFrame, date: str) -> DataFrame:
    """Parse the date column if it is still text."""
    if date not in df.columns or is_time(df.schema[date].dataType):
        return df
    return df.withColumn(date, to_time(F.col(date)))


def with_amount(df: DataFrame, date: str = "Date") -> DataFrame:
    """Parse the date and expose the first amount-like column as ``Amount``."""
    df = with_dates(df, date)
    source = pick_column(df.columns, ("Amount", "Total Amount", "Revenue", "Total", "Sales"))
    if source is None or source == "Amount":
        return df
    return df.withColumn("Amount", F.col(source).try_cast("double"))


def read_department(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, encoding="ISO-8859-1")


TRAINING_COLUMNS = ("column_name", "sample_values", "dtype", "label")


def union_training(frames: Sequence[DataFrame]) -> DataFrame:
    """Labelled column descriptions from several tables: checked, trimmed, without repeats."""
    merged = None
    for frame in frames:
        missing = [c for c in TRAINING_COLUMNS if c not in frame.columns]
        if missing:
            raise ValueError(f"training table lacks columns: {', '.join(missing)}")
        part = frame.select(
            F.trim("column_name").alias("column_name"),
            F.trim(F.coalesce("sample_values", F.lit(""))).alias("sample_values"),
            F.trim(F.coalesce("dtype", F.lit("unknown"))).alias("dtype"),
            F.trim("label").alias("label"),
        )
        merged = part if merged is None else merged.unionByName(part)
    return merged.where((F.col("column_name") != "") & (F.col("label") != "")).dropDuplicates(list(TRAINING_COLUMNS))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(max(1, min(rows, 50)))
