"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when((hour >= 5) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 18), "afternoon")
        .when((hour >= 18) & (hour < 23), "evening")
        .otherwise("late")
    )


def utc_day(ts: Column) -> Column:
    """Calendar day under the session time zone, which is UTC."""
    return F.to_date(ts)
