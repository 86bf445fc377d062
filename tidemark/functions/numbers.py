"""Exact sums and the one rounding rule: half-up on the decimal form of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"


def exact_sum(c: Column) -> Column:
    """Sum of doubles in decimals, so that it does not depend on the order of rows."""
    return F.sum(c.cast("decimal(28,18)"))


def stored_sum(c: Column) -> Column:
    """Sum of doubles as SQL's DECIMAL(38,18) takes them, by the number that is stored and not by its shortest text; in any order of rows the same.

    Where such a sum is next to 0 its sign tells one from the other. Each value times 10^18 is a whole number, summed in two halves.
    """
    whole = F.rint(c * 1e18)
    high = F.floor(whole / float(1 << 32))
    low = (whole - high.cast("double") * float(1 << 32)).cast("long")
    return (F.sum(high).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(low).cast("decimal(20,0)")).cast("double") / 1e18


def scrub(c: Column) -> Column:
    """No negative zero."""
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def half_up(c: Column, digits: int = 1) -> Column:
    return scrub(F.round(c.cast("double"), digits))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole of two counts, half-up on the exact ratio; null where whole is 0."""
    ratio = F.try_divide((F.lit(100) * part).cast("decimal(20,0)"), whole.cast("decimal(18,0)"))
    return F.round(ratio, digits).cast("double")


def certainty(confidence: Column) -> Column:
    """Whole percent of a confidence. A double times 100 would turn 0.29 into 28."""
    return F.round(confidence.cast(EXACT) * 100).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
