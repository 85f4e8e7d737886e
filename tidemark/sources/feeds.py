"""Landed JSON payloads to typed rows.

Every parser takes a DataFrame with one payload per row in a string column, so
the same code serves ``spark.read.text(..., wholetext=True)`` over a landing
folder, a table of payloads, or a stream of them. A stream of the dated feeds
names its date format, because a format cannot be looked for in rows to come.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import timefn
from tidemark.session import stage_table
from tidemark.sources.contracts import ContractError, cast_to_contract

# The date formats the demand and forecast feeds have used.
DATE_FORMATS = ("dd-MMM-yy", "dd-MMM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss")
# The shape a text must have before a format is tried: a failed parse is far
# dearer than a failed match.
SHAPE_OF = {"yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMM": "[A-Za-z]{3}", "MM": "[0-9]{2}",
            "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}", "'T'": "T"}
HOURLY_VARIABLES = (
    "temperature_2m",
    "dew_point_2m",
    "wind_speed_10m",
    "cloud_cover",
    "shortwave_radiation",
)
# Forecast feed column names and ours.
FORECAST_NAMES = {
    "Demand_Forecast": "demand_forecast_mw",
    "Demand_Outturn": "demand_outturn_mw",
    "APE": "ape_percent",
}
OUTAGE_REQUIRED = ("mrid", "revisionNumber", "publishTime", "eventStartTime")
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: its text as ``payload`` and its name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.input_file_name().alias("source_file")
    )


def fail_unless(test: Column, message: Column | str, value: Column) -> Column:
    """``value`` where the test holds, otherwise a task error with the message."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(test, value).otherwise(F.raise_error(text))


def paged_records(
    payloads: DataFrame,
    fields: Sequence[str],
    payload: str = "payload",
    resource: str | None = None,
) -> DataFrame:
    """``{success, result: {records: [...], total}}`` pages to one row per record.

    A page with success = false or without a list of records is an error.
    ``resource`` names the column that says which pages belong together; then a
    resource without records, or with other than the total its pages state, is
    an error too. Without it, each page must hold a record. Fields arrive as
    strings.
    """
    record = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    page = T.StructType(
        [
            T.StructField("success", T.BooleanType()),
            T.StructField(
                "result",
                T.StructType(
                    [
                        T.StructField("records", T.ArrayType(record)),
                        T.StructField("total", T.LongType()),
                    ]
                ),
            ),
        ]
    )
    parsed = payloads.withColumn("__page", F.from_json(payload, page)).drop(payload)
    if not payloads.isStreaming:
        # Totals and dates are looked at before the rows are made: a page is parsed once for all.
        parsed = stage_table(parsed, "pages")
    records = F.col("__page.result.records")
    n = F.coalesce(F.size(records), F.lit(-1))
    if resource is None:
        records = fail_unless(n > 0, "no records in the page", records)
    else:
        whole = parsed.groupBy(resource).agg(
            F.sum(F.greatest(n, F.lit(0))).alias("__received"),
            F.min(n).alias("__least"),
            F.max("__page.result.total").alias("__total"),
        )
        parsed = parsed.join(whole, resource, "left")
        got, total = F.col("__received"), F.coalesce("__total", "__received")
        stated = F.concat(got.cast("string"), F.lit(" records received, total is "), total.cast("string"))
        records = fail_unless(got == total, stated, records)
        records = fail_unless((F.col("__least") >= 0) & (got > 0), "no records", records)
    success = F.coalesce(F.col("__page.success"), F.lit(False))
    records = fail_unless(success, "page reports success=false", records)
    keep = [c for c in payloads.columns if c != payload]
    return parsed.select(*keep, F.explode(records).alias("__r")).select(*keep, "__r.*")


def format_shape(pattern: str) -> str:
    """Regular expression of the texts a date format can read."""
    parts = re.findall("|".join([*SHAPE_OF, "."]), pattern)
    return "^" + "".join(SHAPE_OF.get(p, re.escape(p)) for p in parts) + "$"


def pick_date_format(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> str:
    """The first format that parses every non-null value of the column.

    One aggregate tries all formats; the driver sees one row of counts.
    """
    value = F.col(column)

    def unreadable(f: str) -> Column:
        fits = F.when(value.rlike(format_shape(f)), F.try_to_timestamp(value, F.lit(f)))
        return value.isNotNull() & fits.isNull()

    misses = df.agg(
        *(F.count_if(unreadable(f)).alias(f"f{i}") for i, f in enumerate(formats)),
        F.min(value).alias("sample"),
    ).first()
    for i, f in enumerate(formats):
        if misses[f"f{i}"] == 0:
            return f
    raise ContractError(f"unrecognised date format in {column!r} (sample={misses['sample']!r})")


def parse_dates(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Parse the whole column with one format; no mixing of formats within it.

    The format is looked for in the rows, unless only one is given; a stream needs that.
    Two-digit years mean 1969 to 2068, where Spark alone would read 2000 to 2099.
    """
    if len(formats) > 1 and df.isStreaming:
        raise ContractError(f"a stream of {column!r} needs one date format, got {list(formats)}")
    chosen = formats[0] if len(formats) == 1 else pick_date_format(df, column, formats)
    day = F.to_timestamp(F.col(column), chosen).cast("date")
    if "yy" in chosen and "yyyy" not in chosen:
        day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
    return df.withColumn(column, day)


def demand_rows(
    payloads: DataFrame,
    retrieved_at: Column,
    year: Column | None = None,
    resource: str | None = None,
    formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Half-hourly demand pages to the demand contract."""
    fields = ("SETTLEMENT_DATE", "SETTLEMENT_PERIOD", "ND", "TSD")
    rows = paged_records(payloads, fields, resource=resource)
    rows = parse_dates(rows, "SETTLEMENT_DATE", formats)
    instant = timefn.settlement_to_utc("SETTLEMENT_DATE", "SETTLEMENT_PERIOD")
    return cast_to_contract(
        rows.select(
            instant.alias("timestamp_utc"),
            # An instant has one value; the local column differs in rendering only.
            instant.alias("timestamp_local"),
            F.col("SETTLEMENT_DATE").alias("settlement_date"),
            F.col("SETTLEMENT_PERIOD").alias("settlement_period"),
            F.col("ND").alias("nd_mw"),
            F.col("TSD").alias("tsd_mw"),
            (year if year is not None else F.year("SETTLEMENT_DATE")).alias("source_year"),
            retrieved_at.alias("retrieved_at_utc"),
        ),
        schemas.DEMAND,
    )


def forecast_rows(
    payloads: DataFrame,
    retrieved_at: Column,
    measurements: Sequence[str] = tuple(FORECAST_NAMES),
    resource: str | None = None,
    formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Forecast archive pages; measurements not asked for become null columns."""
    unknown = [m for m in measurements if m not in FORECAST_NAMES]
    if unknown:
        raise ContractError(f"unknown measurement(s): {unknown}")
    fields = ("Date", "Settlement_Period", *measurements)
    rows = paged_records(payloads, fields, resource=resource)
    rows = parse_dates(rows, "Date", formats)
    instant = timefn.settlement_to_utc("Date", "Settlement_Period")
    return cast_to_contract(
        rows.select(
            instant.alias("timestamp_utc"),
            instant.alias("timestamp_local"),
            F.col("Date").alias("settlement_date"),
            F.col("Settlement_Period").alias("settlement_period"),
            *(F.col(m).alias(FORECAST_NAMES[m]) for m in measurements),
            retrieved_at.alias("retrieved_at_utc"),
        ),
        schemas.FORECAST,
        backfill=dict.fromkeys(FORECAST_NAMES.values()),
    )


def weather_rows(
    payloads: DataFrame,
    retrieved_at: Column,
    requested: Sequence[str] = HOURLY_VARIABLES,
    payload: str = "payload",
    station: str = "station",
) -> DataFrame:
    """Parallel hourly arrays to one row per hour and station.

    Arrays of another length than ``time`` are an error, and so is a payload
    without a requested variable. Times without an offset are UTC.
    """
    strings = T.ArrayType(T.StringType())
    block = T.StructType(
        [
            T.StructField("time", strings),
            *(T.StructField(v, strings) for v in requested),
        ]
    )
    parsed = payloads.withColumn(
        "__h", F.from_json(payload, T.StructType([T.StructField("hourly", block)]))["hourly"]
    )
    hours = F.size("__h.time")
    aligned = F.lit(True)
    for v in requested:
        aligned = aligned & F.coalesce(F.size(F.col(f"__h.{v}")) == hours, F.lit(False))
    zipped = fail_unless(
        F.coalesce(aligned, F.lit(False)),
        F.concat(F.lit("hourly arrays missing or of unequal length for "), F.col(station)),
        F.arrays_zip("__h.time", *(F.col(f"__h.{v}") for v in requested)),
    )
    rows = parsed.select(F.col(station).alias("station"), F.explode(zipped).alias("__z"))
    return cast_to_contract(
        rows.select(
            F.to_timestamp(F.col("__z.time")).alias("timestamp_utc"),
            "station",
            *(F.col(f"__z.{v}").alias(v) for v in requested),
            retrieved_at.alias("retrieved_at_utc"),
        ),
        schemas.WEATHER,
        backfill={**dict.fromkeys(HOURLY_VARIABLES), "cloud_cover": 0},
    )


def holiday_rows(
    payloads: DataFrame,
    retrieved_at: Column,
    divisions: Sequence[str] = schemas.DIVISIONS,
    payload: str = "payload",
) -> DataFrame:
    """Nested ``{division: {events: [...]}}`` to rows of the wanted divisions."""
    event = T.StructType(
        [
            T.StructField("title", T.StringType()),
            T.StructField("date", T.StringType()),
            T.StructField("notes", T.StringType()),
            T.StructField("bunting", T.BooleanType()),
        ]
    )
    feed = T.MapType(
        T.StringType(),
        T.StructType(
            [
                T.StructField("division", T.StringType()),
                T.StructField("events", T.ArrayType(event)),
            ]
        ),
    )
    known = F.array(*(F.lit(d) for d in schemas.DIVISIONS))
    parsed = payloads.withColumn("__f", F.from_json(payload, feed))
    names = F.map_keys("__f")
    complete = (F.size(F.array_except(names, known)) == 0) & (
        F.size(F.array_except(known, names)) == 0
    )
    blocks = fail_unless(
        F.coalesce(complete, F.lit(False)),
        F.concat(F.lit("unknown or missing division in: "), F.concat_ws(",", names)),
        F.col("__f"),
    )
    exploded = parsed.select(F.explode(blocks).alias("division", "block")).filter(
        F.col("division").isin(*divisions)
    )
    events = fail_unless(
        F.col("block.events").isNotNull(),
        F.concat(F.lit("no events list in division "), F.col("division")),
        F.col("block.events"),
    )
    rows = exploded.select("division", F.explode(events).alias("e"))
    complete_event = F.col("e.date").isNotNull() & F.col("e.title").isNotNull()
    return cast_to_contract(
        rows.select(
            fail_unless(
                complete_event,
                F.concat(F.lit("event without date or title in "), F.col("division")),
                F.col("e.date"),
            ).alias("date"),
            "division",
            F.col("e.title").alias("title"),
            F.coalesce(F.col("e.notes"), F.lit("")).alias("notes"),
            F.coalesce(F.col("e.bunting"), F.lit(False)).alias("bunting"),
            retrieved_at.alias("retrieved_at_utc"),
        ),
        schemas.HOLIDAYS,
    )


def iso_instant(value: Column) -> Column:
    """ISO-8601 text to an instant; '' and null pass as null, a missing offset fails."""
    text = F.nullif(value, F.lit(""))
    return F.when(
        text.isNotNull(),
        fail_unless(
            text.rlike(OFFSET),
            F.concat(F.lit("timestamp without offset: "), text),
            F.to_timestamp(text),
        ),
    )


def outage_rows(payloads: DataFrame, retrieved_at: Column, payload: str = "payload") -> DataFrame:
    """Arrays of outage messages to the outage log contract.

    Four fields are required per record. A status outside the vocabulary is
    kept; count such rows with ``checks.unknown_values``.
    """
    # Feed field names.
    fields = (
        "mrid",
        "revisionNumber",
        "messageType",
        "eventStatus",
        "publishTime",
        "eventStartTime",
        "eventEndTime",
        "affectedUnit",
        "assetId",
        "fuelType",
        "unavailableCapacity",
        "normalCapacity",
        "eventType",
        "cause",
        "messageDescription",
    )
    message = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    parsed = payloads.withColumn("__m", F.from_json(payload, T.ArrayType(message)))
    records = fail_unless(
        F.col("__m").isNotNull(), "payload is not an array of messages", F.col("__m")
    )
    rows = parsed.select(F.explode(records).alias("m"))
    complete = F.lit(True)
    for f in OUTAGE_REQUIRED:
        complete = complete & F.col(f"m.{f}").isNotNull()
    return cast_to_contract(
        rows.select(
            fail_unless(
                complete,
                F.concat(F.lit("record lacks a required field: "), F.to_json("m")),
                F.col("m.mrid"),
            ).alias("mrid"),
            F.col("m.revisionNumber").alias("revision_number"),
            F.coalesce("m.messageType", F.lit("Unknown")).alias("message_type"),
            F.coalesce("m.eventStatus", F.lit("Unknown")).alias("message_status"),
            iso_instant(F.col("m.publishTime")).alias("published_at"),
            iso_instant(F.col("m.eventStartTime")).alias("effective_from"),
            iso_instant(F.col("m.eventEndTime")).alias("effective_to"),
            retrieved_at.alias("retrieved_at_utc"),
            F.col("m.affectedUnit").alias("affected_unit"),
            F.col("m.assetId").alias("asset_id"),
            F.col("m.fuelType").alias("fuel_type"),
            F.col("m.unavailableCapacity").alias("affected_mw"),
            F.col("m.normalCapacity").alias("normal_capacity_mw"),
            F.col("m.eventType").alias("event_type"),
            F.col("m.cause").alias("cause"),
            F.col("m.messageDescription").alias("message_description"),
        ),
        schemas.OUTAGES,
    )
