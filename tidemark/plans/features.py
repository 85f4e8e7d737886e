"""The three hourly feature tables, each an exact column prefix of the next."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import timefn
from tidemark.operators import bitemporal, ordered, resample
from tidemark.sources.contracts import cast_to_contract, require_instants
from tidemark.sources.tables import provenance

TS = "timestamp_utc"


def join_and_fill(
    demand_hourly: DataFrame,
    weather_national: DataFrame,
    fill_limit: int = 3,
) -> DataFrame:
    """Demand x weather on the hour, bounded fill of weather, incomplete rows dropped.

    Both inputs hold one row per hour, as the hourly operators give them. The
    fill runs over rows of the joined table and never creates hours. The joined
    table is as long as the calendar, whatever the raw feeds weigh; the ordered
    step stages it, so that the feeds are scanned once.
    """
    weather_columns = list(schemas.WEATHER_COLUMNS)
    demand = demand_hourly.dropna(subset=list(schemas.DEMAND_COLUMNS))
    joined = demand.join(weather_national.select(TS, *weather_columns), TS, "inner")
    if fill_limit > 0:
        indexed = ordered.row_index(joined, TS, cut=ordered.balanced())
        joined = ordered.bounded_fill(indexed, weather_columns, fill_limit).drop("ix")
    return joined.dropna(subset=weather_columns)


def weather_only(
    demand: DataFrame,
    weather: DataFrame,
    weights: Mapping[str, float],
    agg: str = "mean",
    fill_limit: int = 3,
    demand_stamp: Column | None = None,
    weather_stamp: Column | None = None,
    validate: bool = True,
) -> DataFrame:
    """Hourly demand with the weighted weather mean."""
    require_instants(demand, TS)
    require_instants(weather, TS)
    hourly = resample.hourly_demand(demand, agg)
    national = resample.station_mean(weather, weights, validate=validate)
    built = join_and_fill(hourly, national, fill_limit)
    return cast_to_contract(
        built.withColumns(
            {
                "neso_retrieved_at_utc": provenance(demand, explicit=demand_stamp),
                "weather_retrieved_at_utc": provenance(weather, explicit=weather_stamp),
            }
        ),
        schemas.WEATHER_ONLY,
    )


def holiday_days(holidays: DataFrame) -> DataFrame:
    """One row per holiday date with membership flags of the encoded divisions."""
    ew, sco = schemas.DIVISIONS[0], schemas.DIVISIONS[1]
    return holidays.groupBy("date").agg(
        F.max((F.col("division") == ew).cast("byte")).alias("ew"),
        F.max((F.col("division") == sco).cast("byte")).alias("sco"),
    )


def shared_holidays(holidays: DataFrame) -> DataFrame:
    """Dates that are a holiday in both encoded divisions."""
    return holiday_days(holidays).filter((F.col("ew") == 1) & (F.col("sco") == 1)).select("date")


def holiday_flags(days: DataFrame, holidays: DataFrame, day: str = "local_date") -> DataFrame:
    """The four flags for each day; 0 before the earliest known holiday.

    Days meet one small flag table: each holiday date marks itself, the day
    before and the day after, and marks of one day are combined.
    """
    per_date = holiday_days(holidays)
    both = (F.col("ew") == 1) & (F.col("sco") == 1)
    zero = F.lit(0).cast("byte")

    def mark(d: Column, ew: Column, sco: Column, eve: Column, after: Column) -> Column:
        names = schemas.HOLIDAY_FLAGS
        return F.struct(
            d.alias(day), *(c.alias(n) for n, c in zip(names, (ew, sco, eve, after), strict=True))
        )

    shared = both.cast("byte")
    marks = per_date.select(
        F.explode(
            F.array(
                mark(F.col("date"), F.col("ew"), F.col("sco"), zero, zero),
                mark(F.date_sub("date", 1), zero, zero, shared, zero),
                mark(F.date_add("date", 1), zero, zero, zero, shared),
            )
        ).alias("m")
    ).select("m.*")
    flags = marks.groupBy(day).agg(*(F.max(c).alias(c) for c in schemas.HOLIDAY_FLAGS))
    floor = holidays.agg(F.min("date").alias("d")).scalar()
    known = F.coalesce(F.col(day) >= floor, F.lit(False))
    return days.join(flags, day, "left").select(
        *days.columns,
        *(
            F.when(known, F.coalesce(F.col(c), zero)).otherwise(zero).cast("byte").alias(c)
            for c in schemas.HOLIDAY_FLAGS
        ),
    )


def with_calendar_columns(df: DataFrame, holidays: DataFrame, ts: str = TS) -> DataFrame:
    """Append the 45 calendar columns to an hourly frame."""
    require_instants(df, ts)
    local = df.withColumn("local_date", timefn.local_wall(ts).cast("date"))
    flagged = holiday_flags(local, holidays)
    return flagged.select(
        *df.columns,
        *timefn.calendar_flags(ts),
        *schemas.HOLIDAY_FLAGS,
        timefn.is_dst(ts).alias("is_dst"),
    )


def weather_calendar(
    features: DataFrame, holidays: DataFrame, holidays_stamp: Column | None = None
) -> DataFrame:
    """``weather_only`` plus the calendar columns and their stamp."""
    return cast_to_contract(
        with_calendar_columns(features, holidays).withColumn(
            "holidays_retrieved_at_utc", provenance(holidays, explicit=holidays_stamp)
        ),
        schemas.WEATHER_CALENDAR,
    )


def with_outages(
    features: DataFrame,
    log: DataFrame,
    extracted: DataFrame | None = None,
    lookahead_hours: int = 24,
    log_stamp: Column | None = None,
    validate: bool = True,
) -> DataFrame:
    """``weather_calendar`` plus the outage roll-up and its stamp.

    ``features`` is read for the grid and for the rows; pass a staged table.
    """
    source = log if extracted is None else bitemporal.override_capacity(log, extracted, validate)
    rollup = bitemporal.outage_rollup(source, features.select(TS), lookahead_hours)
    return cast_to_contract(
        features.join(rollup, TS, "inner").withColumn(
            "remit_retrieved_at_utc", provenance(log, explicit=log_stamp)
        ),
        schemas.WITH_OUTAGES,
    )
