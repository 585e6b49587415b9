"""Points in time as numbers and text, in UTC; 0 stands for an open end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_millis(at: Column) -> Column:
    return F.coalesce(F.unix_millis(at.cast("timestamp")), F.lit(0))


def from_millis(n: Column) -> Column:
    return F.timestamp_millis(F.nullif(n, F.lit(0)))


def utc_text(at: Column) -> Column:
    """Sortable text of fixed width, to the microsecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
