"""Date expressions. All of them give null on bad input instead of raising."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(raw: Column) -> Column:
    """ISO date or timestamp text to a zone-free timestamp."""
    return F.trim(raw.cast("string")).try_cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    """Zone-free timestamp to text. Formatting would go through the session's zone and its gaps."""
    return F.translate(F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 19), " ", "T")


def month_start(year: Column, month: Column) -> Column:
    """First day of a month given as two numbers or texts."""
    y = F.trim(year.cast("string")).try_cast("int")
    m = F.trim(month.cast("string")).try_cast("int")
    text = F.format_string("%04d-%02d-01", y, m)
    return F.when(y.between(1, 9999) & m.between(1, 12), text.try_cast("date"))
