"""Calendar days of time zones; ``now`` is always a column of epoch seconds, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(now: Column, zone: Column | str) -> Column:
    """The local date of an instant."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(now), zone))


def next_day_boundary(now: Column, zone: Column | str) -> Column:
    """Epoch seconds of the next local midnight, right across changes of summer time."""
    return F.unix_timestamp(F.to_utc_timestamp(F.date_add(day_key(now, zone), 1).cast("timestamp"), zone)).cast("double")
