"""Ordered operators: running values, as-of lookups, windows by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest, ordered
from tidemark.operators.ordered import Running
from tidemark.session import stage
from tidemark.plans import training
from workload import query, roles
from workload.roles import HOURLY, ntz, rounded

_IX = f"WITH {HOURLY}, ix AS (SELECT *, row_number() OVER (ORDER BY timestamp_utc) - 1 AS ix FROM hourly)"


@query(
    "row_positions",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix FROM events",
)
def row_positions(spark, sf):
    events = roles.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ordered.row_index(events, ["ts", "event_id"], ["user_id"]).select(
        "event_id", "user_id", "ix"
    )


@query(
    "running_values",
    """SELECT event_id, sum(c) OVER w AS total, min(c) OVER w AS lowest, max(c) OVER w AS highest,
last_value(CASE WHEN c % 3 = 0 THEN c END IGNORE NULLS) OVER w AS last_third
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def running_values(spark, sf):
    events = roles.table(spark, sf, "events").select(
        "event_id", "event_type", "ts", roles.cents().alias("c")
    )
    events = events.withColumn("third", F.when(F.col("c") % 3 == 0, F.col("c")))
    values = {
        "total": Running("sum", "c"),
        "lowest": Running("min", "c"),
        "highest": Running("max", "c"),
        "last_third": Running("last", "third"),
    }
    out = ordered.running(
        events, ["ts", "event_id"], values, ["event_type"]
    )
    return out.select("event_id", *values)


@query(
    "interval_running_total",
    """WITH d AS (SELECT l_shipdate AS t, l_quantity AS delta FROM lineitem
UNION ALL SELECT l_shipdate + to_days(1 + l_linenumber), -l_quantity FROM lineitem),
g AS (SELECT t, sum(delta) AS delta FROM d GROUP BY 1)
SELECT t, delta, sum(delta) OVER (ORDER BY t) AS total FROM g""",
)
def interval_running_total(spark, sf):
    items = roles.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("start"),
        F.timestamp_add("DAY", F.col("l_linenumber") + 1, F.col("l_shipdate")).alias("end"),
        F.col("l_quantity").alias("mw"),
    )
    return ntz(ordered.running_total(items, "start", "end", "mw"))


@query(
    "step_lookup",
    """WITH d AS (SELECT l_shipdate AS t, sum(l_quantity) AS level FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS t FROM orders)
SELECT o_orderkey, g.t AS t, coalesce(level, 0e0) AS level FROM g ASOF LEFT JOIN d ON g.t >= d.t""",
)
def step_lookup(spark, sf):
    """Level of the latest ship date at or before each order; none before the first."""
    steps = (
        roles.table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").alias("t"))
        .agg(F.sum("l_quantity").alias("level"))
    )
    orders = roles.table(spark, sf, "orders").select(
        "o_orderkey",
        F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 24) * 3_600_000_000).alias("t"),
    )
    # Many orders share an instant; the lookup asks once per instant.
    found = ordered.step_lookup(steps, orders, "t", "level", default=0.0)
    return ntz(found.select("o_orderkey", "t", "level"))


@query(
    "same_weekday_lookup",
    f"""WITH {HOURLY}, h AS (SELECT *, isodow(timestamp_utc) AS dow, hour(timestamp_utc) AS hod FROM hourly),
g AS (SELECT event_id, ts, isodow(ts) AS dow, hour(ts) AS hod FROM events)
SELECT g.event_id, g.ts, h.nd_mw AS y_pred FROM g ASOF LEFT JOIN h ON g.dow = h.dow AND g.hod = h.hod AND g.ts >= h.timestamp_utc""",
)
def same_weekday_lookup(spark, sf):
    history = roles.hourly(spark, sf)
    wanted = roles.table(spark, sf, "events")
    asked = wanted.select("event_id", F.col("ts").alias("timestamp_utc"))
    hit = backtest.same_weekday(history, asked, "nd_mw")
    return ntz(hit.withColumnRenamed("timestamp_utc", "ts"))


@query(
    "fixed_lag_lookup",
    f"""WITH {HOURLY} SELECT a.timestamp_utc, CAST(b.nd_mw AS DOUBLE) AS yesterday, CAST(c.nd_mw AS DOUBLE) AS last_week
FROM hourly a LEFT JOIN hourly b ON b.timestamp_utc = a.timestamp_utc - INTERVAL 24 HOUR
LEFT JOIN hourly c ON c.timestamp_utc = a.timestamp_utc - INTERVAL 168 HOUR""",
)
def fixed_lag_lookup(spark, sf):
    hourly = roles.hourly(spark, sf).select("timestamp_utc", "nd_mw")
    day = backtest.fixed_lag(hourly, 24, "nd_mw", name="yesterday")
    week = backtest.fixed_lag(day, 168, "nd_mw", name="last_week")
    return ntz(week.select("timestamp_utc", "yesterday", "last_week"))


@query(
    "sequence_windows",
    f"""{_IX} SELECT ix, win AS "window", CAST(nd_mw AS FLOAT) AS target FROM (
SELECT ix, nd_mw, list([CAST(nd_mw AS FLOAT), CAST(tsd_mw AS FLOAT)]) OVER (ORDER BY ix ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS win FROM ix) WHERE len(win) = 6""",
)
def sequence_windows(spark, sf):
    series = training.prepare(roles.hourly(spark, sf))
    return ordered.sequence_windows(series, ["nd_mw", "tsd_mw"], "nd_mw", 6)


@query(
    "lagged_rows_per_key",
    """SELECT event_id, lag(value, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS value_3_back FROM events""",
)
def lagged_rows_per_key(spark, sf):
    events = roles.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    indexed = stage(ordered.row_index(events, ["ts", "event_id"], ["event_type"]))
    return ordered.lagged(indexed, "value", 3, "value_3_back", ["event_type"], block=500).select(
        "event_id", "value_3_back"
    )
