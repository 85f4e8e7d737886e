"""Stream queries: the tables as file streams, drained to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.session import ensure_session
from tidemark.streaming import live
from workload import query, roles
from workload.roles import OUTAGE_LOG, ntz


def file_stream(spark, sf, name):
    ensure_session(spark)
    return (
        spark.readStream.schema(roles.TABLES[name])
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(sf)
    )


@query(
    "stream_hourly_values",
    'SELECT date_trunc(\'hour\', ts) AS hour, event_type, avg(CAST(round(value * 100) AS BIGINT)) AS mean, max(CAST(round(value * 100) AS BIGINT)) AS "max", count(*) AS n FROM events GROUP BY 1, 2',
)
def stream_hourly_values(spark, sf):
    events = file_stream(spark, sf, "events").withColumn("cents", roles.cents())
    hourly = live.hourly(events, "ts", "cents", ["event_type"])
    updates = live.drain(hourly, "stream-hourly", "update")
    return ntz(live.newest(updates, ["event_type", "hour"]))


@query("stream_deduplicated", "SELECT DISTINCT o_custkey, o_orderdate FROM orders")
def stream_deduplicated(spark, sf):
    """Replays of the same (customer, day) within the bound are dropped."""
    orders = file_stream(spark, sf, "orders").select("o_custkey", "o_orderdate")
    unique = live.deduplicate(orders, ["o_custkey", "o_orderdate"], "o_orderdate", "4000 days")
    return ntz(live.drain(unique, "stream-unique").select("o_custkey", "o_orderdate"))


@query(
    "stream_current_state",
    f"""WITH {OUTAGE_LOG}, l AS (SELECT mrid, revision_number, message_status, row_number() OVER (PARTITION BY mrid ORDER BY revision_number DESC) AS rn FROM log)
SELECT mrid, revision_number FROM l WHERE rn = 1 AND message_status <> 'Withdrawn'""",
)
def stream_current_state(spark, sf):
    status = F.when(F.col("o_orderpriority").startswith("5"), "Withdrawn").otherwise("Active")
    messages = file_stream(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("mrid"),
        F.col("o_orderkey").cast("int").alias("revision_number"),
        status.alias("message_status"),
    )
    updates = live.drain(live.current_state(messages), "stream-state", "update")
    return live.known(live.newest(updates, ["mrid"])).select("mrid", "revision_number")
