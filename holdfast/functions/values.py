"""Ids, dates and stakes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(lei: Column, source: Column, record: Column) -> Column:
    """``lei:<code>`` where there is a code, else ``<source>:<record>``."""
    return F.when(lei != "", F.concat(F.lit("lei:"), lei)).otherwise(F.concat(source, F.lit(":"), record))


def full_date(text: Column) -> Column:
    """A whole ISO date; null for a year or a month alone and for days that do not exist."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.trim(text).try_cast("date"))


def in_force(end: Column, as_of: str) -> Column:
    """Whether a designation that ends at ``end`` (ISO text, also partial) is in force on ``as_of``."""
    return end.isNull() | (end > as_of)


def every_meets(low: Column, low_closed: Column, sign: str, threshold: int) -> Column:
    """Whether every value of a stake is above (``>``) or at least (``>=``) the threshold."""
    return (low > threshold) | ((low == threshold) & ~low_closed) if sign == ">" else low >= threshold


def some_meets(high: Column, high_closed: Column, sign: str, threshold: int) -> Column:
    """Whether some value of a stake is above or at least the threshold."""
    return high > threshold if sign == ">" else (high > threshold) | ((high == threshold) & high_closed)
