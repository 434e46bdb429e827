"""Column functions for status and registration timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: layout of the timestamps after the leading day name.
STATUS_TIME_FORMAT = "MMM dd HH:mm:ss z yyyy"


def parse_status_time(text: Column) -> Column:
    """Timestamp of texts such as ``Wed Nov 23 21:04:11 UTC 2016``; null when the text does not fit.

    The day name is redundant and not parseable in current Spark, so it is cut off first.
    """
    return F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]+ +", ""), F.lit(STATUS_TIME_FORMAT))


def is_off_hours(ts: Column) -> Column:
    """Before six in the morning or from ten in the evening on, in the session's zone."""
    hour = F.hour(ts)
    return (hour < 6) | (hour > 21)


def years_since_1900(ts: Column) -> Column:
    return F.year(ts) - F.lit(1900)
