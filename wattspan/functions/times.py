"""ISO-8601 UTC timestamps as epoch milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"


def epoch_ms(timestamp: Column) -> Column:
    """Milliseconds of a 'Z' timestamp, fractions cut to three digits; null if it is not one."""
    whole = F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(timestamp, 1, 19), F.lit("Z"))))
    digits = F.rpad(F.substring(F.regexp_extract(timestamp, r"\.(\d+)Z$", 1), 1, 3), 3, "0").cast("long")
    return F.when(timestamp.rlike(_ISO), whole * 1000 + digits)


def iso_ms(ms: Column) -> Column:
    """'Z' timestamp with three digits of a second."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_hour(ms: Column) -> Column:
    return F.pmod(F.floor(ms / 3_600_000), F.lit(24)).cast("int")


def utc_month(ms: Column) -> Column:
    return F.month(F.timestamp_millis(ms))
