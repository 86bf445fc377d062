"""Civil days of a time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def civil_day(df: DataFrame, column: str, tz: str = "America/New_York") -> Column:
    """Date of a UTC instant in ``tz``: half-open civil days, 23 or 25 hours at clock changes. Null stays null."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(column)).cast("date")
    return F.to_date(F.from_utc_timestamp(F.col(column), tz))


def day_bounds(day: Column, tz: str = "America/New_York") -> tuple[Column, Column]:
    """UTC instants of a day's midnight and the next one."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), tz)
    return at(day), at(F.date_add(day, 1))


def when_text(previous: Column, day: Column) -> Column:
    return F.when(previous == F.date_sub(day, 1), "yesterday").otherwise(F.date_format(previous, "E MMM d"))
