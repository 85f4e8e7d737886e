"""Feed parsing, contracts and table writing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators import checks, extract
from tidemark.session import ensure_session, scratch_path
from tidemark.sources import contracts, feeds, tables
from tidemark.sources.tables import CachePolicy
from workload import query, roles
from workload.outages import RawFields
from workload.roles import HOURLY, OUTAGE_LOG, ntz, rounded
from workload.series import stamp

RETRIEVED = "2024-02-01"


def demand_payloads(spark, sf):
    """Two pages of one record for each order, which state their common total."""
    key = F.col("o_orderkey")

    def record(period, nd):
        return F.struct(
            F.date_format("o_orderdate", "dd-MMM-yy").alias("SETTLEMENT_DATE"),
            period.cast("string").alias("SETTLEMENT_PERIOD"),
            nd.cast("string").alias("ND"),
            (nd + 5).cast("string").alias("TSD"),
        )

    def page(item):
        result = F.struct(F.array(item).alias("records"), F.lit(2).alias("total"))
        return F.to_json(F.struct(F.lit(True).alias("success"), result.alias("result")))

    pages = F.array(page(record(key % 46 + 1, key)), page(record((key + 1) % 46 + 1, key + 1)))
    return roles.table(spark, sf, "orders").select(
        key.alias("resource"), F.explode(pages).alias("payload")
    )


_START = "timezone('UTC', timezone('Europe/London', o_orderdate) + to_minutes(({k} % 46) * 30))"


@query(
    "demand_feed_rows",
    "SELECT timestamp_utc, timestamp_utc AS timestamp_local, settlement_date, settlement_period, nd_mw, nd_mw + 5 AS tsd_mw, CAST(year(settlement_date) AS SMALLINT) AS source_year, TIMESTAMP '2024-02-01' AS retrieved_at_utc FROM ("
    + " UNION ALL ".join(
        f"SELECT {_START.format(k=f'(o_orderkey + {d})')} AS timestamp_utc, CAST(o_orderdate AS DATE) AS settlement_date, CAST((o_orderkey + {d}) % 46 + 1 AS TINYINT) AS settlement_period, CAST(o_orderkey + {d} AS INTEGER) AS nd_mw FROM orders"
        for d in (0, 1)
    )
    + ")",
)
def demand_feed_rows(spark, sf):
    return ntz(
        feeds.demand_rows(demand_payloads(spark, sf), stamp(RETRIEVED), resource="resource")
    )


@query(
    "forecast_feed_rows",
    f"""SELECT {_START.format(k="o_orderkey")} AS timestamp_utc, {_START.format(k="o_orderkey")} AS timestamp_local, CAST(o_orderdate AS DATE) AS settlement_date, CAST(o_orderkey % 46 + 1 AS TINYINT) AS settlement_period,
CAST(o_orderkey AS INTEGER) AS demand_forecast_mw, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey + 9 AS INTEGER) END AS demand_outturn_mw, CAST(NULL AS DOUBLE) AS ape_percent, TIMESTAMP '2024-02-01' AS retrieved_at_utc FROM orders""",
)
def forecast_feed_rows(spark, sf):
    """A feed whose outturn is sometimes unreadable and whose third measure is not asked for."""
    key = F.col("o_orderkey")
    record = F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("Date"),
        (key % 46 + 1).cast("string").alias("Settlement_Period"),
        key.cast("string").alias("Demand_Forecast"),
        F.when(key % 5 != 0, (key + 9).cast("string")).otherwise("n/a").alias("Demand_Outturn"),
        F.lit("extra").alias("Month"),
    )
    page = F.struct(
        F.lit(True).alias("success"),
        F.struct(F.array(record).alias("records"), F.lit(1).alias("total")).alias("result"),
    )
    payloads = roles.table(spark, sf, "orders").select(F.to_json(page).alias("payload"))
    rows = feeds.forecast_rows(
        payloads, stamp(RETRIEVED), ("Demand_Forecast", "Demand_Outturn")
    )
    return ntz(rounded(rows))


@query(
    "weather_feed_rows",
    """SELECT TIMESTAMP '2024-01-01' + to_hours(vec_id) + to_hours(i) AS timestamp_utc, 'S' || label AS station, round(CAST(embedding[i + 1] AS DOUBLE), 5) AS temperature_2m,
round(CAST(embedding[64 - i] AS DOUBLE), 5) AS dew_point_2m, CAST(NULL AS DOUBLE) AS wind_speed_10m, CAST(CASE WHEN i % 4 = 0 THEN 0 ELSE i END AS TINYINT) AS cloud_cover, CAST(NULL AS DOUBLE) AS shortwave_radiation, TIMESTAMP '2024-02-01' AS retrieved_at_utc
FROM embeddings, LATERAL (SELECT unnest(range(64)) AS i)""",
)
def weather_feed_rows(spark, sf):
    """Vectors as hourly arrays; some cloud readings are missing."""
    hours = F.sequence(F.lit(0), F.lit(63))
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("vec_id") * 3_600_000_000
    times = F.transform(
        hours,
        lambda i: F.date_format(F.timestamp_micros(start + i.cast("bigint") * 3_600_000_000), "yyyy-MM-dd'T'HH:mm"),
    )
    block = F.struct(
        times.alias("time"),
        F.col("embedding").alias("temperature_2m"),
        F.reverse("embedding").alias("dew_point_2m"),
        F.transform(hours, lambda i: F.when(i % 4 != 0, i)).alias("cloud_cover"),
    )
    payloads = roles.table(spark, sf, "embeddings").select(
        F.concat(F.lit("S"), F.col("label").cast("string")).alias("station"),
        F.to_json(F.struct(block.alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"),
    )
    rows = feeds.weather_rows(
        payloads, stamp(RETRIEVED), ("temperature_2m", "dew_point_2m", "cloud_cover")
    )
    return ntz(rounded(rows, 5))


@query(
    "holiday_feed_rows",
    """SELECT CAST(o_orderdate AS DATE) + d AS date, division, 'Day ' || o_orderkey AS title, CASE WHEN d = 0 THEN 'kept' ELSE '' END AS notes, d = 0 AS bunting, TIMESTAMP '2024-02-01' AS retrieved_at_utc
FROM orders, LATERAL (SELECT unnest([0, 1]) AS d, unnest(['england-and-wales', 'scotland']) AS division)""",
)
def holiday_feed_rows(spark, sf):
    def block(days, notes, bunting):
        event = F.struct(
            F.concat(F.lit("Day "), F.col("o_orderkey").cast("string")).alias("title"),
            F.date_format(F.date_add(F.col("o_orderdate").cast("date"), days), "yyyy-MM-dd").alias("date"),
            F.lit(notes).cast("string").alias("notes"),
            F.lit(bunting).cast("boolean").alias("bunting"),
        )
        return F.struct(F.array(event).alias("events"))

    payload = F.to_json(
        F.struct(
            block(0, "kept", True).alias("england-and-wales"),
            block(1, None, None).alias("scotland"),
            block(2, None, None).alias("northern-ireland"),
        )
    )
    payloads = roles.table(spark, sf, "orders").select(payload.alias("payload"))
    return ntz(
        feeds.holiday_rows(payloads, stamp(RETRIEVED), ("england-and-wales", "scotland"))
    )


def outage_payloads(spark, sf):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    log = roles.outage_log(spark, sf)
    message = F.struct(
        F.col("mrid").alias("mrid"),
        F.col("revision_number").alias("revisionNumber"),
        F.when(F.col("message_status") != "Dismissed", F.col("message_status")).alias("eventStatus"),
        iso("published_at").alias("publishTime"),
        iso("effective_from").alias("eventStartTime"),
        iso("effective_to").alias("eventEndTime"),
        F.col("affected_mw").alias("unavailableCapacity"),
        F.col("fuel_type").alias("fuelType"),
        F.col("cause").alias("cause"),
    )
    return log.select(F.to_json(F.array(message)).alias("payload"))


@query(
    "outage_feed_rows",
    f"""WITH {OUTAGE_LOG} SELECT mrid, revision_number, 'Unknown' AS message_type, CASE WHEN message_status = 'Dismissed' THEN 'Unknown' ELSE message_status END AS message_status,
published_at, effective_from, effective_to, TIMESTAMP '2024-02-01' AS retrieved_at_utc, CAST(NULL AS VARCHAR) AS affected_unit, CAST(NULL AS VARCHAR) AS asset_id, fuel_type, affected_mw,
CAST(NULL AS DOUBLE) AS normal_capacity_mw, CAST(NULL AS VARCHAR) AS event_type, cause, CAST(NULL AS VARCHAR) AS message_description FROM log""",
)
def outage_feed_rows(spark, sf):
    return ntz(feeds.outage_rows(outage_payloads(spark, sf), stamp(RETRIEVED)))


_ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


@query("exact_schema_read", "SELECT * FROM orders")
def exact_schema_read(spark, sf):
    return contracts.read_exact(ensure_session(spark), f"{sf}/orders.parquet", _ORDERS)


@query("required_columns_read", "SELECT o_orderkey, o_orderpriority FROM orders")
def required_columns_read(spark, sf):
    wanted = T.StructType([_ORDERS["o_orderkey"], _ORDERS["o_orderpriority"]])
    return contracts.read_required(ensure_session(spark), f"{sf}/orders.parquet", wanted)


@query("known_columns_only", "SELECT event_id, user_id, value FROM events")
def known_columns_only(spark, sf):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return contracts.require_columns(
            roles.table(spark, sf, "events"), ["event_id", "user_id", "value"]
        )


@query(
    "cast_to_contract",
    "SELECT p_partkey, CAST(p_size AS TINYINT) AS p_size, round(CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE), 2) AS p_retailprice FROM part",
)
def cast_to_contract(spark, sf):
    contract = T.StructType(
        [
            T.StructField("p_partkey", T.IntegerType()),
            T.StructField("p_size", T.ByteType()),
            T.StructField("p_retailprice", T.FloatType()),
        ]
    )
    return rounded(contracts.cast_to_contract(roles.table(spark, sf, "part"), contract), 2)


@query(
    "backfill_and_lenient_cast",
    """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id % 100 AS VARCHAR) END AS TINYINT), 0) AS cloud_cover,
TRY_CAST(CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS temperature_2m, CAST(NULL AS DOUBLE) AS dew_point_2m FROM events""",
)
def backfill_and_lenient_cast(spark, sf):
    contract = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("cloud_cover", T.ByteType()),
            T.StructField("temperature_2m", T.DoubleType()),
            T.StructField("dew_point_2m", T.DoubleType()),
        ]
    )
    key = F.col("event_id")
    raw = roles.table(spark, sf, "events").select(
        "event_id",
        F.when(key % 3 == 0, F.col("event_type"))
        .otherwise((F.col("user_id") % 100).cast("string"))
        .alias("cloud_cover"),
        F.when(key % 2 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias(
            "temperature_2m"
        ),
    )
    return contracts.cast_to_contract(
        raw, contract, backfill={"cloud_cover": 0, "dew_point_2m": None}, lenient=["temperature_2m"]
    )


@query("one_format_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def one_format_dates(spark, sf):
    text = roles.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd-MMM-yyyy").alias("day")
    )
    return feeds.parse_dates(text, "day")


@query(
    "iso_instants",
    "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS at FROM events",
)
def iso_instants(spark, sf):
    """Texts with an offset of two hours; every fifth is empty."""
    text = F.when(F.col("event_id") % 5 == 0, "").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    )
    events = roles.table(spark, sf, "events")
    return ntz(events.select("event_id", feeds.iso_instant(text).alias("at")))


@query(
    "provenance_stamp",
    "SELECT o_orderkey, (SELECT min(o_orderdate) FROM orders) AS stamp FROM orders",
)
def provenance_stamp(spark, sf):
    orders = roles.table(spark, sf, "orders")
    return ntz(orders.select("o_orderkey", tables.provenance(orders, "o_orderdate").alias("stamp")))


@query("materialised_hourly", f"WITH {HOURLY} SELECT * FROM hourly")
def materialised_hourly(spark, sf):
    """Build once, replace atomically, then reuse offline."""
    path = scratch_path(ensure_session(spark), "hourly")

    def build():
        return roles.hourly(spark, sf)

    tables.materialise(spark, path, build, CachePolicy.AUTO, ["timestamp_utc"])
    tables.materialise(spark, path, build, CachePolicy.REFRESH, ["timestamp_utc"])
    return ntz(tables.materialise(spark, path, build, CachePolicy.OFFLINE))


@query(
    "extracted_events_table",
    f"""WITH {OUTAGE_LOG} SELECT mrid, revision_number, coalesce(event_type, 'Other') AS event_type, affected_mw AS affected_capacity_mw, TIMESTAMP '2024-02-01' AS extracted_at_utc FROM log""",
)
def extracted_events_table(spark, sf):
    """One result row per log row, written and read under its contract."""

    class Confident(RawFields):
        def extract(self, log):
            none = F.lit(None).cast("string")
            return super().extract(log).select(
                "*", F.lit(1.0).alias("confidence"), none.alias("prompt_hash"), none.alias("model_id")
            )

    table = extract.extracted_table(roles.outage_log(spark, sf), Confident(), stamp(RETRIEVED))
    path = tables.replace_table(table, scratch_path(spark, "extracted"), ["mrid", "revision_number"])
    back = contracts.read_exact(spark, path, schemas.EXTRACTED)
    return ntz(
        back.select(
            "mrid", "revision_number", "event_type", "affected_capacity_mw", "extracted_at_utc"
        )
    )


@query(
    "yearly_union",
    "SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders",
)
def yearly_union(spark, sf):
    """A part for each year there is, stacked."""
    orders = roles.table(spark, sf, "orders")
    first, last = orders.agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    parts = [
        orders.filter(
            (F.col("o_orderdate") >= f"{y}-01-01") & (F.col("o_orderdate") < f"{y + 1}-01-01")
        ).select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
        for y in range(first, last + 1)
    ]
    return tables.union_tables(parts)


@query(
    "observed_quality",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS not_urgent FROM orders""",
)
def observed_quality(spark, sf):
    """Counters that ride along with a write."""
    orders = roles.table(spark, sf, "orders")
    watched, seen = checks.observe_counts(
        orders,
        "orders_quality",
        n_rows=F.count(F.lit(1)),
        not_urgent=F.count_if(~F.col("o_orderpriority").startswith("1")),
    )
    tables.replace_table(watched.select("o_orderkey"), scratch_path(spark, "orders"))
    counts = seen.get
    return spark.createDataFrame(
        [(counts["n_rows"], counts["not_urgent"])], "n_rows long, not_urgent long"
    )
