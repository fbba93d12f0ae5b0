"""Local-day columns of UTC instants kept as TIMESTAMP_NTZ, so that results do not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"


def utc(ts: Column) -> Column:
    return ts.cast("timestamp_ntz")


def bucket(ts: Column, minutes: int = 15) -> Column:
    """Start of the ``minutes`` bucket of the day (a divisor of 1440) that holds ``ts``."""
    into = (F.hour(ts) * 60 + F.minute(ts)) % minutes
    start = F.date_trunc("minute", utc(ts)).cast("timestamp_ntz")
    return (start - F.make_dt_interval(mins=into)).cast("timestamp_ntz")


def local(ts: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc(ts))


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return local(ts, zone).cast("date")


def mtu(ts: Column, zone: str = ZONE) -> Column:
    """Quarter-hour of the local day: hour * 4 + minute div 15."""
    here = local(ts, zone)
    return (F.hour(here) * 4 + F.floor(F.minute(here) / 15)).cast("int")


def day_start(day: Column, zone: str = ZONE) -> Column:
    """UTC instant at which the local calendar day begins."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def next_day_start(day: Column, zone: str = ZONE) -> Column:
    return day_start(F.date_add(day, 1), zone)


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a UTC instant."""
    whole = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return whole + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("long")


def slots(day: Column, zone: str = ZONE) -> Column:
    """Quarter-hours of the local day: 92, 96 or 100."""
    return ((seconds(next_day_start(day, zone)) - seconds(day_start(day, zone))) / 900).cast("int")


def plus(ts: Column, **parts: int) -> Column:
    """``ts`` moved by a fixed length of days, hours, minutes or seconds."""
    return ts + F.make_dt_interval(F.lit(parts.get("days", 0)), F.lit(parts.get("hours", 0)), F.lit(parts.get("mins", 0)), F.lit(parts.get("secs", 0)))
