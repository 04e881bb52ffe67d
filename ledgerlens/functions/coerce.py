"""Text clean-up and tolerant parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "no value" when a whole cell holds them.
SANITIZE_NULLS = ("", "nan", "none", "null", "na")
DIMENSION_NULLS = ("", "unknown", "n/a", "na", "none", "null", "nan")

NUMBER_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Removed first, so that most amounts need no pattern replacement.
CURRENCY = "$€£¥, "

# Shapes of readable dates. Numbers in any order are rewritten to year-month-day, so one
# tolerant cast reads them; a pattern parser (which throws inside on a miss) only sees
# texts that have its shape.
DATE_LIKE = r"^(?:\d{1,4}[-/. ]\w|\d{4}$|[A-Za-z]{3} \d)"
YEAR_LAST = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(.*)$"
YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(.*)$"
ISO_SHAPE = r"^(1[6-9]|2[0-2])\d{2}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?$"
NAMED_MONTHS = {
    r"^\d{1,2} [A-Za-z]{3} \d{4}$": "d MMM yyyy",
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$": "MMM d, yyyy",
}


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or NULL (casts throw internally on the empty text other extractors return)."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def only_if(text: Column, shape: str) -> Column:
    """The text if it has the shape, else NULL; evaluates its input once."""
    return first_match(text, shape)


def squeeze(text: Column) -> Column:
    """Turn runs of white space and the placeholder word ``blank`` into one space; trim. Only texts that hold such meet the pattern."""
    loose = text.rlike(r"  |[\t\n\x0B\f\r]|[bB][lL][aA][nN][kK]")
    return F.trim(F.when(loose, F.regexp_replace(text, r"(?i)(?:\s|blank)+", " ")).otherwise(text))


def sanitize_text(text: Column) -> Column:
    """Squeezed text; NULL when nothing or only a null word is left."""
    words = "|".join(w for w in SANITIZE_NULLS if w)
    squeezed = squeeze(text)
    lines = squeezed.rlike(r"[\x{85}\u2028\u2029]")  # which end a line for the pattern
    return F.when(lines, only_if(squeezed, rf"(?i)^(?!(?:{words})$).+$")).when(~F.lower(squeezed).isin(*SANITIZE_NULLS), squeezed)


def normal_text(text: Column) -> Column:
    """Lower-case letters and digits separated by single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+", " "))


def normal_key(text: Column) -> Column:
    """Column version of the header key: lower, without ``blank``, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "blank", " "), "[^a-z0-9]", "")


def clean_dimension(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(F.lower(text).isin(*DIMENSION_NULLS), F.lit(None)).otherwise(text)


# The parsers below name their input as rarely as they can: a filter on a parsed
# column is pushed down with its expression, and every mention copies what lies below.


def plain_number(text: Column) -> Column:
    """A text that is a number as it stands. The shape keeps the throwing parser away from other texts."""
    return only_if(text, NUMBER_SHAPE).try_cast("double")


def to_number(value: Column) -> Column:
    """``(1,234.50)`` -> -1234.5, ``$120`` -> 120.0, anything unreadable -> NULL."""
    text = value.cast("string")
    signed = F.regexp_replace(F.translate(text, CURRENCY, ""), r"\(([^)]+)\)", "-$1")
    return F.when(text.rlike("[0-9]"), plain_number(F.regexp_replace(signed, r"[^0-9.\-]+", "")))


def to_time(value: Column, day_first: bool = False) -> Column:
    """Read a date or time text; the flag decides ``03/02/2025``. NULL when unreadable."""
    text = F.trim(value.cast("string"))
    order = "$3-$2-$1$4" if day_first else "$3-$1-$2$4"
    iso = F.regexp_replace(F.regexp_replace(text, YEAR_LAST, order), YEAR_FIRST, "$1-$2-$3$4")
    named = [F.try_to_timestamp(only_if(text, shape), F.lit(p)) for shape, p in NAMED_MONTHS.items()]
    return F.when(text.rlike(DATE_LIKE), F.coalesce(F.try_to_timestamp(only_if(iso, ISO_SHAPE)), *named))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete days between two times."""
    return F.timestamp_diff("DAY", earlier, later)


def month_index(date: Column) -> Column:
    """Months since year 0, so that differences count calendar months."""
    return F.year(date) * F.lit(12) + F.month(date) - F.lit(1)


def month_label(index: Column) -> Column:
    """``yyyy-MM`` of a month index."""
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def lit_like(value, dtype: T.DataType) -> Column:
    """A literal of a column's own type (keeps TIMESTAMP and TIMESTAMP_NTZ apart)."""
    return F.lit(None if value is None else str(value)).cast(dtype)
