"""Time and duration texts. Instants and durations are bigint microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
DAY = 86_400 * SECOND


def micros(seconds: float) -> int:
    return round(seconds * SECOND)


def floor_div(a: Column, n: int | Column) -> Column:
    """Whole-number division rounding down, also for negative values."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.call_function("div", a - F.pmod(a, n), n)


def as_time(us: Column) -> Column:
    """Un-zoned UTC timestamp of an instant."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def format_ts(us: Column) -> Column:
    """ISO-8601; milliseconds, cut off rather than rounded, only when there is a sub-second part."""
    t = F.timestamp_micros(us)
    text = F.when(us % SECOND != 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(text, F.lit("N/A"))


def format_duration(us: Column) -> Column:
    """`Xh Ym Zs` of the absolute value, whole seconds, leading zero units left out."""
    total = floor_div(F.abs(us), SECOND)
    hours = floor_div(total, 3600)
    minutes = floor_div(total % 3600, 60)
    seconds = total % 60
    return (F.when(total >= 3600, F.format_string("%dh %dm %ds", hours, minutes, seconds))
            .when(total >= 60, F.format_string("%dm %ds", minutes, seconds))
            .when(total.isNotNull(), F.format_string("%ds", seconds)))


def format_relative(us: Column, base: Column) -> Column:
    """`HH:MM:SS (T±duration)` against a base instant; the absolute text where there is no base."""
    clock = F.date_format(F.timestamp_micros(us), "HH:mm:ss")
    delta = us - base
    return (F.when(delta < 0, F.concat(clock, F.lit(" (T-"), format_duration(delta), F.lit(")")))
            .when(delta > 0, F.concat(clock, F.lit(" (T+"), format_duration(delta), F.lit(")")))
            .when(delta == 0, clock)
            .otherwise(format_ts(us)))
