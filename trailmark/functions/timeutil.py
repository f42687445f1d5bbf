"""Timestamp arithmetic that is exact and independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def epoch_micros(col: Column) -> Column:
    """Microseconds since the epoch of a wall-clock (UTC) timestamp."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", epoch, col.cast("timestamp_ntz"))


def floor_div(x: Column, d: int) -> Column:
    """Exact floor(x / d) for integers (also for negative x)."""
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("bigint")


def heartbeat_bucket(col: Column, heartbeat: int) -> Column:
    """floor(epoch seconds / heartbeat) as a BIGINT."""
    return floor_div(epoch_micros(col), heartbeat * 1_000_000)


def seconds_between(start: Column, end: Column) -> Column:
    """Number of whole-second boundaries crossed from ``start`` to ``end``."""
    return floor_div(epoch_micros(end), 1_000_000) - floor_div(epoch_micros(start), 1_000_000)


def minus_seconds(col: Column, seconds: int) -> Column:
    return col - F.make_dt_interval(secs=F.lit(seconds))
