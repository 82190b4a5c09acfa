"""Time arithmetic on UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def from_millis(ms: Column) -> Column:
    """Epoch milliseconds, fractions allowed, as a timestamp."""
    return F.timestamp_micros((ms * 1000).cast("long"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def months_before(ts: Column, months: int) -> Column:
    return ts - F.make_interval(F.lit(0), F.lit(months))


def age_days(now_micros: Column, then_micros: Column) -> Column:
    """Days between, never below zero."""
    return F.greatest((now_micros - then_micros) / float(MICROS_PER_DAY), F.lit(0.0))


def half_life_weight(days: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), days / float(half_life))
