"""Table contracts: ordered column names and types of every dataset."""

from __future__ import annotations

from pyspark.sql import types as T

TS, DATE, STR = T.TimestampType(), T.DateType(), T.StringType()
INT, SHORT, BYTE, LONG = T.IntegerType(), T.ShortType(), T.ByteType(), T.LongType()
FLOAT, DOUBLE, BOOL = T.FloatType(), T.DoubleType(), T.BooleanType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# Column names, order and types of the public tables.
DEMAND = _schema(
    ("timestamp_utc", TS),
    ("timestamp_local", TS),
    ("settlement_date", DATE),
    ("settlement_period", BYTE),
    ("nd_mw", INT),
    ("tsd_mw", INT),
    ("source_year", SHORT),
    ("retrieved_at_utc", TS),
)
FORECAST = _schema(
    ("timestamp_utc", TS),
    ("timestamp_local", TS),
    ("settlement_date", DATE),
    ("settlement_period", BYTE),
    ("demand_forecast_mw", INT),
    ("demand_outturn_mw", INT),
    ("ape_percent", FLOAT),
    ("retrieved_at_utc", TS),
)
WEATHER = _schema(
    ("timestamp_utc", TS),
    ("station", STR),
    ("temperature_2m", FLOAT),
    ("dew_point_2m", FLOAT),
    ("wind_speed_10m", FLOAT),
    ("cloud_cover", BYTE),
    ("shortwave_radiation", FLOAT),
    ("retrieved_at_utc", TS),
)
HOLIDAYS = _schema(
    ("date", DATE),
    ("division", STR),
    ("title", STR),
    ("notes", STR),
    ("bunting", BOOL),
    ("retrieved_at_utc", TS),
)
OUTAGES = _schema(
    ("mrid", STR),
    ("revision_number", INT),
    ("message_type", STR),
    ("message_status", STR),
    ("published_at", TS),
    ("effective_from", TS),
    ("effective_to", TS),
    ("retrieved_at_utc", TS),
    ("affected_unit", STR),
    ("asset_id", STR),
    ("fuel_type", STR),
    ("affected_mw", DOUBLE),
    ("normal_capacity_mw", DOUBLE),
    ("event_type", STR),
    ("cause", STR),
    ("message_description", STR),
)
EXTRACTED = _schema(
    ("mrid", STR),
    ("revision_number", INT),
    ("event_type", STR),
    ("fuel_type", STR),
    ("affected_capacity_mw", DOUBLE),
    ("effective_from", TS),
    ("effective_to", TS),
    ("confidence", FLOAT),
    ("prompt_hash", STR),
    ("model_id", STR),
    ("extracted_at_utc", TS),
)

DEMAND_COLUMNS = ("nd_mw", "tsd_mw")
WEATHER_COLUMNS = (
    "temperature_2m",
    "dew_point_2m",
    "wind_speed_10m",
    "cloud_cover",
    "shortwave_radiation",
)
HOLIDAY_FLAGS = (
    "is_bank_holiday_ew",
    "is_bank_holiday_sco",
    "is_day_before_holiday",
    "is_day_after_holiday",
)
CALENDAR_COLUMNS = (
    *(f"hour_of_day_{h:02d}" for h in range(1, 24)),
    *(f"day_of_week_{d}" for d in range(1, 7)),
    *(f"month_{m:02d}" for m in range(2, 13)),
    *HOLIDAY_FLAGS,
    "is_dst",
)
OUTAGE_COLUMNS = (
    "remit_unavail_mw_total",
    "remit_active_unplanned_count",
    "remit_unavail_mw_next_24h",
)
MESSAGE_STATUSES = ("Active", "Inactive", "Cancelled", "Withdrawn", "Dismissed")
DIVISIONS = ("england-and-wales", "scotland", "northern-ireland")

WEATHER_ONLY = _schema(
    ("timestamp_utc", TS),
    *((c, INT) for c in DEMAND_COLUMNS),
    *((c, FLOAT) for c in WEATHER_COLUMNS),
    ("neso_retrieved_at_utc", TS),
    ("weather_retrieved_at_utc", TS),
)
WEATHER_CALENDAR = T.StructType(
    [
        *WEATHER_ONLY.fields,
        *_schema(*((c, BYTE) for c in CALENDAR_COLUMNS)).fields,
        T.StructField("holidays_retrieved_at_utc", TS),
    ]
)
WITH_OUTAGES = T.StructType(
    [
        *WEATHER_CALENDAR.fields,
        *_schema(*zip(OUTAGE_COLUMNS, (FLOAT, INT, FLOAT), strict=True)).fields,
        T.StructField("remit_retrieved_at_utc", TS),
    ]
)
FEATURE_SETS = {
    "weather_only": WEATHER_ONLY,
    "weather_calendar": WEATHER_CALENDAR,
    "with_remit": WITH_OUTAGES,
}
