"""Times as numbers, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column) -> Column:
    """Microseconds of a naive time since 1970; differences are not touched by any zone's transitions."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))
