"""The benchmark tables in the roles of the library's inputs.

Each role has a Spark form and the same rows as a SQL fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ensure_session

# Instants are read as UTC; declaring the schema avoids a cast above the scan,
# so that time filters still reach parquet.
TABLES = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, "
    "value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp",
}

WEIGHTS = {"click": 8.0, "view": 2.0, "purchase": 2.0, "signup": 1.0}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ensure_session(spark)
    reader = spark.read
    if name in TABLES:
        reader = reader.schema(TABLES[name])
    return reader.parquet(f"{sf}/{name}.parquet")


def ntz(df: DataFrame) -> DataFrame:
    """Instants as zone-less timestamps, the form the SQL side returns."""
    return df.select(
        *(
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, for comparison across engines."""
    return df.select(
        *(
            F.round(F.col(f.name).cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def cents(column: str = "value") -> Column:
    """Whole hundredths: sums of them do not depend on the order of addition."""
    return F.round(F.col(column) * 100).cast("bigint")


def half_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Half-hourly demand: summed event value."""
    events = table(spark, sf, "events")
    half = 1_800_000_000
    slot = F.timestamp_micros(F.floor(F.unix_micros("ts") / half) * half)
    return (
        events.groupBy(slot.alias("timestamp_utc"))
        .agg(F.sum(cents()).alias("c"), F.count("*").alias("n"))
        .select(
            "timestamp_utc",
            F.bround(F.col("c") / 100, 0).cast("int").alias("nd_mw"),
            (F.bround(F.col("c") / 100, 0) + F.col("n")).cast("int").alias("tsd_mw"),
        )
    )


HALF_HOURLY = """
half_hourly AS (
  SELECT timestamp_utc,
         CAST(round_even(c / 100e0, 0) AS INTEGER) AS nd_mw,
         CAST(round_even(c / 100e0, 0) + n AS INTEGER) AS tsd_mw
  FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS timestamp_utc,
               sum(CAST(round(value * 100) AS BIGINT)) AS c, count(*) AS n
        FROM events GROUP BY 1))"""

HOURLY = (
    HALF_HOURLY
    + """,
hourly AS (
  SELECT date_trunc('hour', timestamp_utc) AS timestamp_utc,
         CAST(round_even(avg(nd_mw), 0) AS INTEGER) AS nd_mw,
         CAST(round_even(avg(tsd_mw), 0) AS INTEGER) AS tsd_mw
  FROM half_hourly GROUP BY 1)"""
)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.resample import hourly_demand

    return hourly_demand(half_hourly(spark, sf), "mean")


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Hour x station readings, with gaps."""
    events = table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = events.groupBy(hour.alias("timestamp_utc"), F.col("event_type").alias("station")).agg(
        F.sum(cents()).alias("c"),
        F.count("*").alias("n"),
        F.min(cents()).alias("lo"),
        F.max(cents()).alias("hi"),
        F.sum(k).alias("k"),
    )
    dark = F.hour("timestamp_utc").isin(3, 4, 15) | (
        (F.dayofmonth("timestamp_utc") == 10) & F.hour("timestamp_utc").between(5, 12)
    )
    n = F.col("n")
    return base.select(
        "timestamp_utc",
        "station",
        F.when(n != 1, F.col("c") / (n * 300)).alias("temperature_2m"),
        (F.col("lo") / 100).alias("dew_point_2m"),
        F.when(n % 5 != 0, F.col("hi") / 100).alias("wind_speed_10m"),
        n.cast("int").alias("cloud_cover"),
        F.when(~dark, F.col("k").cast("double")).alias("shortwave_radiation"),
    )


WEATHER = """
weather AS (
  SELECT timestamp_utc, station,
         CASE WHEN n <> 1 THEN c / (n * 300e0) END AS temperature_2m,
         lo / 100e0 AS dew_point_2m,
         CASE WHEN n % 5 <> 0 THEN hi / 100e0 END AS wind_speed_10m,
         CAST(n AS INTEGER) AS cloud_cover,
         CASE WHEN NOT (hour(timestamp_utc) IN (3, 4, 15)
                        OR (day(timestamp_utc) = 10 AND hour(timestamp_utc) BETWEEN 5 AND 12))
              THEN CAST(k AS DOUBLE) END AS shortwave_radiation
  FROM (SELECT date_trunc('hour', ts) AS timestamp_utc, event_type AS station,
               sum(CAST(round(value * 100) AS BIGINT)) AS c, count(*) AS n,
               min(CAST(round(value * 100) AS BIGINT)) AS lo,
               max(CAST(round(value * 100) AS BIGINT)) AS hi,
               sum(CAST(props->>'$.k' AS BIGINT)) AS k
        FROM events GROUP BY 1, 2))"""

_W = "CASE station WHEN 'click' THEN 8e0 WHEN 'view' THEN 2e0 WHEN 'purchase' THEN 2e0 WHEN 'signup' THEN 1e0 END"
_VARS = (
    "temperature_2m",
    "dew_point_2m",
    "wind_speed_10m",
    "cloud_cover",
    "shortwave_radiation",
)
NATIONAL = (
    WEATHER
    + ",\nnational AS (\n  SELECT timestamp_utc, "
    + ", ".join(
        f"sum(w * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN w END) AS {v}" for v in _VARS
    )
    + f"\n  FROM (SELECT *, {_W} AS w FROM weather WHERE station <> 'error') GROUP BY 1)"
)

# Demand x national weather, three-row fill, incomplete rows dropped.
FEATURES = (
    HOURLY
    + ","
    + NATIONAL
    + ",\njoined AS (SELECT * FROM hourly JOIN national USING (timestamp_utc)),\nfilled AS (\n"
    + "  SELECT timestamp_utc, nd_mw, tsd_mw, "
    + ", ".join(f"last_value({v} IGNORE NULLS) OVER f AS {v}" for v in _VARS)
    + "\n  FROM joined WINDOW f AS (ORDER BY timestamp_utc ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),\n"
    + "features AS (SELECT * FROM filled WHERE "
    + " AND ".join(f"{v} IS NOT NULL" for v in _VARS)
    + ")"
)


def national(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.resample import station_mean

    return station_mean(weather(spark, sf), WEIGHTS, validate=False)


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.plans.features import join_and_fill

    return join_and_fill(hourly(spark, sf), national(spark, sf), 3)


def order_holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Holiday dates of three divisions, taken from the order book."""
    key = F.col("o_orderkey")
    divisions = F.filter(
        F.array(
            F.when(key % 97 == 0, "england-and-wales"),
            F.when((key % 97 == 0) & (key % 2 == 0), "scotland"),
            F.when(key % 211 == 0, "scotland"),
            F.when(key % 199 == 0, "northern-ireland"),
        ),
        lambda d: d.isNotNull(),
    )
    return (
        table(spark, sf, "orders")
        .select(F.col("o_orderdate").cast("date").alias("date"), F.explode(divisions).alias("division"))
        .distinct()
    )


ORDER_HOLIDAYS = """
holidays AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, division
  FROM orders, LATERAL (SELECT unnest([
      CASE WHEN o_orderkey % 97 = 0 THEN 'england-and-wales' END,
      CASE WHEN o_orderkey % 97 = 0 AND o_orderkey % 2 = 0 THEN 'scotland' END,
      CASE WHEN o_orderkey % 211 = 0 THEN 'scotland' END,
      CASE WHEN o_orderkey % 199 = 0 THEN 'northern-ireland' END]) AS division)
  WHERE division IS NOT NULL)"""


def order_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct order hours, a calendar of several years."""
    ts = F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 24) * 3_600_000_000)
    return table(spark, sf, "orders").select(ts.alias("timestamp_utc")).distinct()


ORDER_HOURS = """
order_hours AS (
  SELECT DISTINCT o_orderdate + to_hours(o_orderkey % 24) AS timestamp_utc FROM orders)"""


def outage_log(spark: SparkSession, sf: str, january: bool = False) -> DataFrame:
    """Orders as a revisioned outage log: customer = message, order = revision.

    Revision numbers do not follow publication order, some revisions are
    withdrawn, and some outages are open. ``january`` folds the years into the
    month the event series covers, with outages of hours instead of days.
    """
    key = F.col("o_orderkey")
    hour = 3_600_000_000
    start = F.unix_micros("o_orderdate")
    if january:
        day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 30
        start = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + day.cast("bigint") * 24 * hour
    unit = hour if january else 24 * hour
    published = start + (key % 24) * hour + (key % 60) * 60_000_000
    begins = published + (key % 9 - 2) * 6 * unit
    ends = begins + (key % 40 + 1) * 5 * unit
    at = F.timestamp_micros
    priority = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("mrid"),
        key.cast("int").alias("revision_number"),
        F.when(priority.startswith("5"), "Withdrawn")
        .when(priority.startswith("4"), "Dismissed")
        .otherwise("Active")
        .alias("message_status"),
        at(published).alias("published_at"),
        at(begins).alias("effective_from"),
        F.when(key % 11 != 0, at(ends)).alias("effective_to"),
        F.when(F.col("o_custkey") % 5 == 0, "Gas")
        .when(F.col("o_custkey") % 5 == 1, "Wind")
        .when(F.col("o_custkey") % 5 == 2, "Nuclear")
        .when(F.col("o_custkey") % 5 == 3, "Coal")
        .alias("fuel_type"),
        F.when(key % 7 != 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias(
            "affected_mw"
        ),
        F.when(priority.startswith("1"), "Unplanned")
        .when(priority.startswith("2"), "UNPLANNED")
        .when(priority.startswith("3"), "Forced")
        .when(priority.startswith("4"), "Planned")
        .alias("cause"),
        F.when(F.col("o_orderstatus") == "F", "Production").alias("event_type"),
        F.concat(F.lit("T_UNIT-"), (F.col("o_custkey") % 50).cast("string")).alias("affected_unit"),
        F.when(key % 3 == 0, F.concat(F.lit("  "), priority, F.lit(" notice "))).alias(
            "message_description"
        ),
    )


def _log_sql(name: str, january: bool) -> str:
    start = (
        "TIMESTAMP '2024-01-01' + to_days(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INTEGER))"
        if january
        else "o_orderdate"
    )
    unit = "to_hours" if january else "to_days"
    cast = "BIGINT" if january else "INTEGER"
    return f"""
{name} AS (
  SELECT *, CASE WHEN revision_number % 11 <> 0
                 THEN effective_from + {unit}(CAST((revision_number % 40 + 1) * 5 AS {cast})) END AS effective_to
  FROM (SELECT *, published_at + {unit}(CAST((revision_number % 9 - 2) * 6 AS {cast})) AS effective_from
  FROM (SELECT CAST(o_custkey AS VARCHAR) AS mrid, CAST(o_orderkey AS INTEGER) AS revision_number,
         CASE left(o_orderpriority, 1) WHEN '5' THEN 'Withdrawn' WHEN '4' THEN 'Dismissed' ELSE 'Active' END AS message_status,
         {start} + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS published_at,
         CASE o_custkey % 5 WHEN 0 THEN 'Gas' WHEN 1 THEN 'Wind' WHEN 2 THEN 'Nuclear' WHEN 3 THEN 'Coal' END AS fuel_type,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS affected_mw,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'Unplanned' WHEN '2' THEN 'UNPLANNED' WHEN '3' THEN 'Forced' WHEN '4' THEN 'Planned' END AS cause,
         CASE WHEN o_orderstatus = 'F' THEN 'Production' END AS event_type,
         'T_UNIT-' || CAST(o_custkey % 50 AS VARCHAR) AS affected_unit,
         CASE WHEN o_orderkey % 3 = 0 THEN '  ' || o_orderpriority || ' notice ' END AS message_description
  FROM orders)))"""


OUTAGE_LOG = _log_sql("log", january=False)
OUTAGE_LOG_JANUARY = _log_sql("log", january=True)
