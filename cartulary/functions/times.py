"""Instants, without depending on the session time zone."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Accepted forms of a time-like partition value, and the regional zone.
EPOCH_FORM = r"^(\d{10})(?:\d{3})?(?:\.\d+)?$"
DAY_FORM = r"^\d{8}$"
REGIONAL_ZONE = "America/Los_Angeles"


def epoch_seconds(wall_clock: Column) -> Column:
    """Seconds since 1970 of a TIMESTAMP_NTZ column read as UTC."""
    return (
        F.unix_date(F.to_date(wall_clock)).cast("bigint") * 86400
        + F.hour(wall_clock) * 3600
        + F.minute(wall_clock) * 60
        + F.second(wall_clock)
    )


def as_instant(wall_clock: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC, as the TIMESTAMP that watermarks need."""
    parts = [f(wall_clock) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
    return F.make_timestamp_ltz(*parts, F.extract(F.lit("SECOND"), wall_clock), F.lit("UTC"))


def partition_time(value: Column, regional: Column | bool = False) -> Column:
    """Epoch seconds of a partition value, null when it has none of the accepted forms.

    Ten digits are seconds, thirteen are milliseconds (a fraction is dropped) and
    eight are a day in UTC, or in the regional zone.  Days and months past the end
    roll over.
    """
    regional = F.lit(regional) if isinstance(regional, bool) else regional
    seconds = F.nullif(F.regexp_extract(value, EPOCH_FORM, 1), F.lit("")).cast("bigint")
    # parts are only cast when the value really has eight digits
    digits = F.when(value.rlike(DAY_FORM), value)
    year, month, day = (
        F.substring(digits, start, size).cast("int") for start, size in ((1, 4), (5, 2), (7, 2))
    )
    first = F.make_date(F.greatest(year, F.lit(1)), F.lit(1), F.lit(1))
    date = F.date_add(F.add_months(first, month - 1), day - 1)
    midnight = F.timestamp_seconds(F.unix_date(date).cast("bigint") * 86400)
    local = F.unix_seconds(F.to_utc_timestamp(midnight, REGIONAL_ZONE))
    return F.coalesce(seconds, F.when(regional, local).otherwise(F.unix_seconds(midnight)))
