"""Column expressions on time: clock changes, calendar flags, Fourier terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/London"
MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_SECOND = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shift(ts: Column | str, micros: Column | int) -> Column:
    """Move an instant by a whole number of microseconds."""
    return F.timestamp_micros(F.unix_micros(_col(ts)) + micros)


def shift_hours(ts: Column | str, hours: int) -> Column:
    return shift(ts, hours * MICROS_PER_HOUR)


def hour_floor(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts))


def hour_ceil(ts: Column | str) -> Column:
    """First whole hour at or after the instant."""
    return F.date_trunc("hour", shift(ts, MICROS_PER_HOUR - 1))


def epoch_hours(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts)) / F.lit(float(MICROS_PER_HOUR))


def local_wall(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Local wall clock, for extracting parts only: its UTC rendering is local time."""
    return F.from_utc_timestamp(_col(ts), zone)


def last_sunday(year: Column, month: int) -> Column:
    month_end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(F.next_day(month_end, "SUN"), 7)


def clock_change_dates(year: Column) -> tuple[Column, Column]:
    """(spring forward, autumn back) Sundays of a year."""
    return last_sunday(year, 3), last_sunday(year, 10)


def local_midnight_utc(day: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(_col(day).cast("timestamp"), zone)


def periods_in_day(day: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Half hours in a local day: 48, or 46 / 50 when clocks change."""
    start = F.unix_seconds(local_midnight_utc(day, zone))
    end = F.unix_seconds(local_midnight_utc(F.date_add(_col(day), 1), zone))
    return ((end - start) / 1800).cast("int")


def settlement_to_utc(
    day: Column | str, period: Column | str, zone: str = LOCAL_ZONE
) -> Column:
    """Half-hour number of a local day to its UTC start.

    Periods count elapsed half hours from local midnight, and midnight is never
    ambiguous, so one addition covers both clock changes. A number beyond the
    day's length is an error.
    """
    p = _col(period).cast("int")
    start = F.unix_micros(local_midnight_utc(day, zone))
    value = F.timestamp_micros(start + (p.cast("long") - 1) * (MICROS_PER_HOUR // 2))
    problem = F.concat(
        F.lit("settlement period out of range: "),
        _col(day).cast("string"),
        F.lit(" period "),
        p.cast("string"),
    )
    return F.when(p.between(1, periods_in_day(day, zone)), value).when(
        p.isNotNull() & _col(day).isNotNull(), F.raise_error(problem).cast("timestamp")
    )


def calendar_flags(ts: Column | str, zone: str = LOCAL_ZONE) -> list[Column]:
    """One-hot hour (UTC), weekday and month (local) without their first level."""
    wall = local_wall(ts, zone)
    hour, weekday, month = F.hour(_col(ts)), F.weekday(wall), F.month(wall)
    return [
        *((hour == h).cast("byte").alias(f"hour_of_day_{h:02d}") for h in range(1, 24)),
        *((weekday == d).cast("byte").alias(f"day_of_week_{d}") for d in range(1, 7)),
        *((month == m).cast("byte").alias(f"month_{m:02d}") for m in range(2, 13)),
    ]


def is_dst(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    offset = F.pmod(F.hour(local_wall(ts, zone)) - F.hour(_col(ts)), F.lit(24))
    return (offset == 1).cast("byte")


def fourier_terms(
    ts: Column | str, period_hours: int, harmonics: int, prefix: str
) -> list[Column]:
    """sin/cos pairs of the hours since the epoch, for k = 1..harmonics."""
    if harmonics < 0:
        raise ValueError(f"harmonics must be >= 0, got {harmonics}")
    hours = epoch_hours(ts)
    terms: list[Column] = []
    for k in range(1, harmonics + 1):
        angle = F.lit(2.0 * 3.141592653589793 * k) * hours / F.lit(float(period_hours))
        terms.append(F.sin(angle).alias(f"{prefix}_sin_k{k}"))
        terms.append(F.cos(angle).alias(f"{prefix}_cos_k{k}"))
    return terms


def degree_terms(
    temperature: Column | str, t_heat: float = 15.5, t_cool: float = 22.0
) -> tuple[Column, Column]:
    """Heating and cooling degrees."""
    t = _col(temperature).cast("double")
    zero = F.lit(0.0)
    return F.greatest(zero, F.lit(t_heat) - t), F.greatest(zero, t - F.lit(t_cool))
