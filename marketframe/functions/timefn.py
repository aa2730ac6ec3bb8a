"""Time functions: expiries, boundaries, Easter. Times are UTC epoch seconds unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expiration(ts: Column, duration: Column | int) -> Column:
    """Expiry of an order: below a minute the next minute (one more from second 30 on); else the next
    multiple of the duration since midnight, one more if over half of the current one has passed."""
    d = F.lit(duration) if isinstance(duration, int) else duration
    minute = ts - F.pmod(ts, F.lit(60)) + 60 + F.when(F.pmod(ts, F.lit(60)) >= 30, 60).otherwise(0)
    midnight = ts - F.pmod(ts, F.lit(86400))
    since = ts - midnight
    left = F.pmod(since, d)
    longer = midnight + ((since - left) / d + F.when(left > d / 2, 2).otherwise(1)) * d
    return F.when(d < 60, minute).otherwise(longer).cast("bigint")


def next_timeframe(ts: Column, timeframe: int, zone_seconds: int = 0) -> Column:
    """The boundary two steps ahead within the hour, as ISO text with milliseconds."""
    passed = F.pmod(ts, F.lit(3600))
    at = ts - passed + (F.floor(passed / timeframe) + 2) * timeframe
    at = at - F.pmod(at, F.lit(60)) - zone_seconds
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def days_ago(now: Column, days: int) -> Column:
    return now - days * 86400


def server_time(now: Column, offset_seconds: int) -> Column:
    return now - offset_seconds


def period_start(now: Column, duration: int) -> Column:
    return now - duration


def selectable_expiries(ts: Column) -> Column:
    """Array of (minutes, expiry): five coming minutes, then eleven quarter hours over 5 minutes away."""
    minute = ts - F.pmod(ts, F.lit(60))
    first = minute + F.when(minute + 60 - ts > 30, 60).otherwise(120)
    short = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((i + 1).alias("minutes"), (first + 60 * i).cast("bigint").alias("expiry")))
    quarter = minute + F.pmod(-minute, F.lit(900))
    start = quarter + F.when(quarter - ts > 300, 0).otherwise(900)
    long = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.struct((15 * (i + 1)).alias("minutes"), (start + 900 * i).cast("bigint").alias("expiry")))
    return F.concat(short, long)


def truncated(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits) / 10**digits


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar as a date (golden number, century and epact rules)."""
    div = lambda a, b: F.floor(a / b)
    golden, century = F.pmod(year, F.lit(19)), div(year, 100)
    moon_shift = div(century - div(century + 8, 25) + 1, 3)
    epact = F.pmod(19 * golden + century - div(century, 4) - moon_shift + 15, F.lit(30))
    rest = F.pmod(year, F.lit(100))
    weekday = F.pmod(32 + 2 * F.pmod(century, F.lit(4)) + 2 * div(rest, 4) - epact - F.pmod(rest, F.lit(4)), F.lit(7))
    late = div(golden + 11 * epact + 22 * weekday, 451)
    days = epact + weekday - 7 * late + 114
    return F.make_date(year.cast("int"), div(days, 31).cast("int"), (F.pmod(days, F.lit(31)) + 1).cast("int"))
