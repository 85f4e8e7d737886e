"""Hourly series, calendar and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import timefn
from tidemark.operators import checks, diagnose, ordered, regress, resample, smooth
from tidemark.plans import features as plans
from tidemark.plans import training
from tidemark.session import stage
from workload import query, roles
from workload.roles import FEATURES, HALF_HOURLY, HOURLY, NATIONAL, ORDER_HOLIDAYS, ORDER_HOURS, ntz, rounded


@query("hourly_demand_mean", f"WITH {HOURLY} SELECT * FROM hourly")
def hourly_demand_mean(spark, sf):
    return ntz(roles.hourly(spark, sf))


@query(
    "hourly_demand_max",
    f"""WITH {HALF_HOURLY}
SELECT date_trunc('hour', timestamp_utc) AS timestamp_utc, max(nd_mw) AS nd_mw, max(tsd_mw) AS tsd_mw
FROM half_hourly GROUP BY 1""",
)
def hourly_demand_max(spark, sf):
    return ntz(resample.hourly_demand(roles.half_hourly(spark, sf), "max"))


# Events of one hour of the day count an hour earlier: the grid must show the gap as nulls.
ARCHIVE = """
archive AS (
  SELECT date_trunc('hour', CASE WHEN hour(ts) = 5 THEN ts - INTERVAL 1 HOUR ELSE ts END) + to_minutes(CASE WHEN user_id % 2 = 0 THEN 0 ELSE 30 END) AS timestamp_utc,
         CAST(sum(CASE WHEN event_type = 'error' THEN NULL ELSE event_id END) AS BIGINT) AS demand_forecast_mw,
         CAST(sum(CASE WHEN event_type = 'view' THEN NULL ELSE event_id + 7 END) AS BIGINT) AS demand_outturn_mw
  FROM events GROUP BY 1)"""


def archive(spark, sf):
    events = roles.table(spark, sf, "events")
    earlier = F.timestamp_micros(F.unix_micros("ts") - 3_600_000_000)
    events = events.withColumn("ts", F.when(F.hour("ts") == 5, earlier).otherwise(F.col("ts")))
    half = F.when(F.col("user_id") % 2 == 0, 0).otherwise(1_800_000_000)
    slot = F.timestamp_micros(F.unix_micros(F.date_trunc("hour", F.col("ts"))) + half)
    kind = F.col("event_type")
    return events.groupBy(slot.alias("timestamp_utc")).agg(
        F.sum(F.when(kind != "error", F.col("event_id"))).alias("demand_forecast_mw"),
        F.sum(F.when(kind != "view", F.col("event_id") + 7)).alias("demand_outturn_mw"),
    )


_GRID = """
grid AS (SELECT unnest(generate_series(date_trunc('hour', min(timestamp_utc)), date_trunc('hour', max(timestamp_utc)), INTERVAL 1 HOUR)) AS timestamp_utc FROM archive)"""


@query(
    "hourly_aligned_mean",
    f"""WITH {ARCHIVE}, {_GRID}
SELECT g.timestamp_utc, round(avg(demand_forecast_mw), 4) AS demand_forecast_mw, round(avg(demand_outturn_mw), 4) AS demand_outturn_mw
FROM grid g LEFT JOIN archive a ON date_trunc('hour', a.timestamp_utc) = g.timestamp_utc GROUP BY 1""",
)
def hourly_aligned_mean(spark, sf):
    return ntz(rounded(resample.hourly_aligned(archive(spark, sf), "mean"), 4))


@query(
    "hourly_aligned_first",
    f"""WITH {ARCHIVE}, {_GRID}
SELECT g.timestamp_utc,
       CAST(arg_min(demand_forecast_mw, a.timestamp_utc) AS DOUBLE) AS demand_forecast_mw,
       CAST(arg_min(demand_outturn_mw, a.timestamp_utc) AS DOUBLE) AS demand_outturn_mw
FROM grid g LEFT JOIN archive a ON date_trunc('hour', a.timestamp_utc) = g.timestamp_utc GROUP BY 1""",
)
def hourly_aligned_first(spark, sf):
    return ntz(resample.hourly_aligned(archive(spark, sf), "first"))


_VAR_ROUND = ", ".join(f"round({v}, 6) AS {v}" for v in schemas.WEATHER_COLUMNS)


@query("station_weighted_mean", f"WITH {NATIONAL} SELECT timestamp_utc, {_VAR_ROUND} FROM national")
def station_weighted_mean(spark, sf):
    return ntz(rounded(resample.station_mean(roles.weather(spark, sf), roles.WEIGHTS)))


@query(
    "daily_peak",
    f"WITH {HOURLY} SELECT date_trunc('day', timestamp_utc)::TIMESTAMP AS day, max(nd_mw) AS peak FROM hourly GROUP BY 1",
)
def daily_peak(spark, sf):
    return ntz(resample.daily_peak(roles.hourly(spark, sf), "nd_mw"))


@query(
    "demand_weather_join",
    f"WITH {HOURLY}, {NATIONAL} SELECT timestamp_utc, nd_mw, tsd_mw, {_VAR_ROUND} FROM hourly JOIN national USING (timestamp_utc)",
)
def demand_weather_join(spark, sf):
    demand = stage(roles.hourly(spark, sf))
    national = stage(roles.national(spark, sf))
    joined = checks.checked_join(demand, national, ["timestamp_utc"], "inner", "one_to_one")
    return ntz(rounded(joined))


@query(
    "demand_weather_complete",
    f"""WITH {HOURLY}, {NATIONAL} SELECT timestamp_utc, nd_mw, round(temperature_2m, 6) AS temperature_2m, round(shortwave_radiation, 6) AS shortwave_radiation
FROM hourly JOIN national USING (timestamp_utc) WHERE temperature_2m IS NOT NULL AND shortwave_radiation IS NOT NULL""",
)
def demand_weather_complete(spark, sf):
    joined = resample.inner_complete(
        roles.hourly(spark, sf).select("timestamp_utc", "nd_mw"),
        roles.national(spark, sf).select("timestamp_utc", "temperature_2m", "shortwave_radiation"),
        ["timestamp_utc"],
        ["temperature_2m", "shortwave_radiation"],
    )
    return ntz(rounded(joined))


@query(
    "bounded_forward_fill",
    f"WITH {FEATURES} SELECT timestamp_utc, nd_mw, tsd_mw, {_VAR_ROUND} FROM features",
)
def bounded_forward_fill(spark, sf):
    return ntz(rounded(roles.feature_rows(spark, sf)))


_STAMPS = "TIMESTAMP '2024-02-01' AS neso_retrieved_at_utc, TIMESTAMP '2024-02-02' AS weather_retrieved_at_utc"
_F32 = ", ".join(
    f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 3) AS {v}" for v in schemas.WEATHER_COLUMNS
)


def stamp(text: str):
    return F.lit(text).cast("timestamp")


def weather_only(spark, sf):
    return plans.weather_only(
        roles.half_hourly(spark, sf),
        roles.weather(spark, sf),
        roles.WEIGHTS,
        demand_stamp=stamp("2024-02-01"),
        weather_stamp=stamp("2024-02-02"),
        validate=False,
    )


@query(
    "feature_table_weather_only",
    f"WITH {FEATURES} SELECT timestamp_utc, nd_mw, tsd_mw, {_F32}, {_STAMPS} FROM features",
)
def feature_table_weather_only(spark, sf):
    return ntz(rounded(weather_only(spark, sf), 3))


JANUARY_HOLIDAYS = """
holidays AS (SELECT * FROM (VALUES (DATE '2024-01-01', 'england-and-wales'), (DATE '2024-01-01', 'scotland'),
  (DATE '2024-01-02', 'scotland'), (DATE '2024-01-15', 'england-and-wales'), (DATE '2024-01-15', 'scotland'),
  (DATE '2024-01-01', 'northern-ireland')) AS t(date, division))"""


def january_holidays(spark):
    rows = [
        ("2024-01-01", "england-and-wales"),
        ("2024-01-01", "scotland"),
        ("2024-01-02", "scotland"),
        ("2024-01-15", "england-and-wales"),
        ("2024-01-15", "scotland"),
        ("2024-01-01", "northern-ireland"),
    ]
    made = spark.createDataFrame(rows, "date string, division string")
    return made.withColumn("date", F.col("date").cast("date"))


def calendar_sql(source: str, keep: str) -> str:
    """Calendar columns over ``source`` (timestamp_utc) and ``holidays``."""
    hot = [f"CAST(hour(timestamp_utc) = {h} AS TINYINT) AS hour_of_day_{h:02d}" for h in range(1, 24)]
    hot += [f"CAST(isodow(wall) = {d + 1} AS TINYINT) AS day_of_week_{d}" for d in range(1, 7)]
    hot += [f"CAST(month(wall) = {m} AS TINYINT) AS month_{m:02d}" for m in range(2, 13)]
    known = "CAST(wall AS DATE) >= (SELECT min(date) FROM holidays)"

    def flag(test: str, name: str) -> str:
        return f"CAST(coalesce({known} AND {test}, false) AS TINYINT) AS {name}"

    day = "CAST(wall AS DATE)"
    hot += [
        flag(f"{day} IN (SELECT date FROM ew)", "is_bank_holiday_ew"),
        flag(f"{day} IN (SELECT date FROM sco)", "is_bank_holiday_sco"),
        flag(f"{day} + 1 IN (SELECT date FROM shared)", "is_day_before_holiday"),
        flag(f"{day} - 1 IN (SELECT date FROM shared)", "is_day_after_holiday"),
        "CAST((hour(wall) - hour(timestamp_utc) + 24) % 24 = 1 AS TINYINT) AS is_dst",
    ]
    return f""",
ew AS (SELECT date FROM holidays WHERE division = 'england-and-wales'),
sco AS (SELECT date FROM holidays WHERE division = 'scotland'),
shared AS (SELECT date FROM ew INTERSECT SELECT date FROM sco),
walled AS (SELECT *, timezone('Europe/London', timezone('UTC', timestamp_utc)) AS wall FROM {source})
SELECT {keep}, {", ".join(hot)}"""


@query(
    "feature_table_weather_calendar",
    f"""WITH {FEATURES}, {JANUARY_HOLIDAYS}
{calendar_sql("features", "timestamp_utc, nd_mw, tsd_mw, " + _F32 + ", " + _STAMPS)},
TIMESTAMP '2024-02-03' AS holidays_retrieved_at_utc,
{", ".join(f"round(sin(2e0 * pi() * {k} * (epoch_us(timestamp_utc) / 3.6e9) / 168e0), 6) AS week_sin_k{k}, round(cos(2e0 * pi() * {k} * (epoch_us(timestamp_utc) / 3.6e9) / 168e0), 6) AS week_cos_k{k}" for k in (1, 2, 3))}
FROM walled""",
)
def feature_table_weather_calendar(spark, sf):
    table = plans.weather_calendar(
        weather_only(spark, sf), january_holidays(spark), stamp("2024-02-03")
    )
    terms = timefn.fourier_terms("timestamp_utc", 168, 3, "week")
    return ntz(rounded(rounded(table, 3).select("*", *terms)))


@query(
    "calendar_columns",
    f"WITH {ORDER_HOURS}, {ORDER_HOLIDAYS} {calendar_sql('order_hours', 'timestamp_utc')} FROM walled",
)
def calendar_columns(spark, sf):
    return ntz(
        plans.with_calendar_columns(roles.order_hours(spark, sf), roles.order_holidays(spark, sf))
    )


@query(
    "shared_holiday_dates",
    f"""WITH {ORDER_HOLIDAYS} SELECT date FROM holidays WHERE division = 'england-and-wales'
INTERSECT SELECT date FROM holidays WHERE division = 'scotland'""",
)
def shared_holiday_dates(spark, sf):
    return plans.shared_holidays(roles.order_holidays(spark, sf))


@query(
    "holiday_membership_flags",
    f"""WITH {ORDER_HOLIDAYS}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS local_date FROM orders),
ew AS (SELECT date FROM holidays WHERE division = 'england-and-wales'),
sco AS (SELECT date FROM holidays WHERE division = 'scotland'),
shared AS (SELECT date FROM ew INTERSECT SELECT date FROM sco), lo AS (SELECT min(date) AS d FROM holidays)
SELECT local_date,
  CAST(local_date >= d AND local_date IN (SELECT date FROM ew) AS TINYINT) AS is_bank_holiday_ew,
  CAST(local_date >= d AND local_date IN (SELECT date FROM sco) AS TINYINT) AS is_bank_holiday_sco,
  CAST(local_date >= d AND local_date + 1 IN (SELECT date FROM shared) AS TINYINT) AS is_day_before_holiday,
  CAST(local_date >= d AND local_date - 1 IN (SELECT date FROM shared) AS TINYINT) AS is_day_after_holiday
FROM days, lo""",
)
def holiday_membership_flags(spark, sf):
    days = roles.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("local_date"))
    return plans.holiday_flags(days.distinct(), roles.order_holidays(spark, sf))


@query(
    "fourier_terms",
    f"""WITH {ORDER_HOURS}, h AS (SELECT timestamp_utc, epoch_us(timestamp_utc) / 3.6e9 AS h FROM order_hours)
SELECT timestamp_utc, {", ".join(f"round(sin(2e0 * pi() * {k} * h / {p}e0), 6) AS {n}_sin_k{k}, round(cos(2e0 * pi() * {k} * h / {p}e0), 6) AS {n}_cos_k{k}" for p, n, ks in ((24, "diurnal", (1, 2, 3)), (168, "weekly", (1, 2))) for k in ks)} FROM h""",
)
def fourier_terms(spark, sf):
    ts = "timestamp_utc"
    terms = timefn.fourier_terms(ts, 24, 3, "diurnal") + timefn.fourier_terms(ts, 168, 2, "weekly")
    return ntz(rounded(roles.order_hours(spark, sf).select(ts, *terms)))


@query(
    "settlement_periods",
    """SELECT o_orderkey, timezone('UTC', timezone('Europe/London', o_orderdate) + to_minutes((o_orderkey % 46) * 30)) AS timestamp_utc,
CAST((epoch(timezone('Europe/London', o_orderdate + INTERVAL 1 DAY)) - epoch(timezone('Europe/London', o_orderdate))) / 1800 AS INTEGER) AS periods
FROM orders""",
)
def settlement_periods(spark, sf):
    day = F.col("o_orderdate").cast("date")
    period = (F.col("o_orderkey") % 46 + 1).cast("byte")
    return ntz(
        roles.table(spark, sf, "orders").select(
            "o_orderkey",
            timefn.settlement_to_utc(day, period).alias("timestamp_utc"),
            timefn.periods_in_day(day).alias("periods"),
        )
    )


@query(
    "clock_change_sundays",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS year FROM orders),
y AS (SELECT DISTINCT year FROM d), s AS (SELECT year, unnest(generate_series(make_date(year, 1, 1)::TIMESTAMP, make_date(year, 12, 31)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM y)
SELECT CAST(year AS INTEGER) AS year, max(CASE WHEN month(day) = 3 AND isodow(day) = 7 THEN day END) AS spring,
max(CASE WHEN month(day) = 10 AND isodow(day) = 7 THEN day END) AS autumn FROM s GROUP BY 1""",
)
def clock_change_sundays(spark, sf):
    years = roles.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    spring, autumn = timefn.clock_change_dates(F.col("year"))
    return years.select("year", spring.alias("spring"), autumn.alias("autumn"))


@query(
    "time_parts",
    """SELECT event_id, date_trunc('hour', ts) AS hour_start, timezone('Europe/London', timezone('UTC', ts)) AS local_time,
CAST(hour(ts) AS INTEGER) AS utc_hour FROM events""",
)
def time_parts(spark, sf):
    return ntz(
        roles.table(spark, sf, "events").select(
            "event_id",
            timefn.hour_floor("ts").alias("hour_start"),
            timefn.local_wall("ts").alias("local_time"),
            F.hour("ts").alias("utc_hour"),
        )
    )


@query(
    "degree_days",
    "SELECT event_id, round(greatest(0e0, 15.5 - value / 3), 6) AS hdd, round(greatest(0e0, value / 3 - 22), 6) AS cdd FROM events",
)
def degree_days(spark, sf):
    heat, cool = timefn.degree_terms(F.col("value") / 3)
    return rounded(
        roles.table(spark, sf, "events").select("event_id", heat.alias("hdd"), cool.alias("cdd"))
    )


@query(
    "last_days_slice",
    "SELECT event_id, ts, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY",
)
def last_days_slice(spark, sf):
    events = roles.table(spark, sf, "events").select("event_id", "ts", "value")
    return ntz(checks.last_days(events, "ts", 7))


@query(
    "holdout_slice",
    "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'",
)
def holdout_slice(spark, sf):
    events = roles.table(spark, sf, "events").select("event_id", "ts")
    return ntz(checks.time_slice(events, "ts", stamp("2024-01-10"), stamp("2024-01-20")))


_PROFILED = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min(CAST({c} AS VARCHAR)) AS min_value, max(CAST({c} AS VARCHAR)) AS max_value FROM orders"
        for c in _PROFILED
    ),
)
def column_profile(spark, sf):
    return checks.profile(roles.table(spark, sf, "orders"), _PROFILED)


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf):
    return checks.value_counts(roles.table(spark, sf, "events"), "event_type")


@query(
    "quality_counters",
    f"""WITH {HOURLY}, {NATIONAL}, j AS (SELECT * FROM hourly JOIN national USING (timestamp_utc))
SELECT count(*) AS n_rows, count(*) FILTER (WHERE shortwave_radiation IS NULL) AS null_shortwave_radiation,
count(*) FILTER (WHERE wind_speed_10m IS NULL) AS null_wind_speed_10m FROM j""",
)
def quality_counters(spark, sf):
    joined = roles.hourly(spark, sf).join(roles.national(spark, sf), "timestamp_utc")
    return joined.agg(
        F.count("*").alias("n_rows"),
        *checks.fill_counters(["shortwave_radiation", "wind_speed_10m"]),
    )


@query(
    "temperature_response_curve",
    f"""WITH {HOURLY}, {NATIONAL} SELECT CAST(floor(temperature_2m / 2e0) AS BIGINT) AS bin, round(avg(nd_mw), 6) AS mean_y, count(*) AS n,
(floor(temperature_2m / 2e0) + 0.5e0) * 2e0 AS x_mid FROM hourly JOIN national USING (timestamp_utc) WHERE temperature_2m IS NOT NULL GROUP BY ALL""",
)
def temperature_response_curve(spark, sf):
    joined = roles.hourly(spark, sf).join(roles.national(spark, sf), "timestamp_utc")
    return rounded(resample.response_curve(joined, "temperature_2m", "nd_mw", 2.0))


def indexed(spark, sf):
    """The hourly demand series with its row position, staged once."""
    return training.prepare(roles.hourly(spark, sf))


_IX = f"WITH {HOURLY}, ix AS (SELECT *, row_number() OVER (ORDER BY timestamp_utc) - 1 AS ix FROM hourly)"


@query(
    "residual_autocorrelation",
    f"""{_IX}, m AS (SELECT avg(nd_mw) AS m, count(*) AS n FROM ix),
d AS (SELECT ix, nd_mw - m AS d FROM ix, m), v AS (SELECT sum(d * d) AS v FROM d),
lags AS (SELECT unnest(generate_series(0, 48)) AS lag),
acf AS (SELECT lag, sum(a.d * b.d) / any_value(v) AS acf FROM lags JOIN d a ON true JOIN d b ON b.ix = a.ix + lag, v GROUP BY lag)
SELECT CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf,
round(CASE WHEN lag = 0 THEN 0e0 ELSE 1.959963984540054e0 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag >= 1 THEN acf * acf END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / n) END, 6) AS band
FROM acf, m""",
)
def residual_autocorrelation(spark, sf):
    return rounded(diagnose.autocorrelation(indexed(spark, sf), "nd_mw", 48))


@query(
    "seasonal_decomposition",
    f"""{_IX}, t AS (SELECT ix, timestamp_utc, nd_mw, CASE WHEN count(*) OVER (ORDER BY ix ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) = 25 THEN
 (sum(nd_mw) OVER (ORDER BY ix ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) + sum(nd_mw) OVER (ORDER BY ix ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)) / 48e0 END AS trend FROM ix),
p AS (SELECT ix % 24 AS phase, avg(nd_mw - trend) AS m FROM t GROUP BY 1), l AS (SELECT avg(m) AS l FROM p)
SELECT ix, timestamp_utc, nd_mw, round(trend, 4) AS trend, round(m - l, 4) AS seasonal, round(nd_mw - trend - (m - l), 4) AS remainder
FROM t JOIN p ON p.phase = t.ix % 24, l""",
)
def seasonal_decomposition(spark, sf):
    parts = diagnose.decompose(indexed(spark, sf).drop("tsd_mw"), "nd_mw", 24)
    return ntz(rounded(parts, 4))


@query(
    "seasonal_difference",
    f"{_IX} SELECT timestamp_utc, nd_mw - lag(nd_mw, 24) OVER (ORDER BY ix) AS diff FROM ix",
)
def seasonal_difference(spark, sf):
    out = ordered.seasonal_difference(indexed(spark, sf), "nd_mw", 24, "diff")
    return ntz(out.select("timestamp_utc", "diff"))


@query(
    "standardised_columns",
    f"""{_IX}, n AS (SELECT count(*) AS n FROM ix),
s AS (SELECT avg(nd_mw) AS m1, stddev_pop(nd_mw) AS s1, avg(tsd_mw) AS m2, stddev_pop(tsd_mw) AS s2 FROM ix, n WHERE ix < n - greatest(25, floor(n * 0.1)))
SELECT timestamp_utc, round((nd_mw - m1) / s1, 6) AS nd_mw, round((tsd_mw - m2) / s2, 6) AS tsd_mw FROM ix, s""",
)
def standardised_columns(spark, sf):
    split = ordered.tail_split(indexed(spark, sf), 0.1, 25)
    scaled = regress.standardise(split, ["nd_mw", "tsd_mw"], ~F.col("is_tail"))
    return ntz(rounded(scaled.select("timestamp_utc", "nd_mw", "tsd_mw")))


@query(
    "tail_split",
    f"{_IX}, n AS (SELECT count(*) AS n FROM ix) SELECT timestamp_utc, ix, ix >= n - greatest(25, floor(n * 0.1)) AS is_tail FROM ix, n",
)
def tail_split(spark, sf):
    split = ordered.tail_split(indexed(spark, sf), 0.1, 25)
    return ntz(split.select("timestamp_utc", "ix", "is_tail"))


@query(
    "hour_weekday_means",
    f"""WITH {HOURLY}, w AS (SELECT timezone('Europe/London', timezone('UTC', timestamp_utc)) AS wall, nd_mw FROM hourly)
SELECT CAST(isodow(wall) - 1 AS INTEGER) AS weekday, CAST(hour(wall) AS INTEGER) AS hour, round(avg(nd_mw), 6) AS mean_error FROM w GROUP BY 1, 2""",
)
def hour_weekday_means(spark, sf):
    return rounded(diagnose.hour_weekday_means(roles.hourly(spark, sf), "nd_mw"))


@query(
    "hour_weekday_pivot",
    f"""WITH {HOURLY}, w AS (SELECT timezone('Europe/London', timezone('UTC', timestamp_utc)) AS wall, nd_mw FROM hourly)
SELECT CAST(isodow(wall) - 1 AS INTEGER) AS weekday, {", ".join(f"round(avg(nd_mw) FILTER (WHERE hour(wall) = {h}), 6) AS h{h:02d}" for h in range(24))} FROM w GROUP BY 1""",
)
def hour_weekday_pivot(spark, sf):
    return rounded(diagnose.hour_weekday_pivot(roles.hourly(spark, sf), "nd_mw"))


_LINE = """m AS (SELECT floor(x / 0.25) AS bin, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM rows WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1),
g AS (SELECT unnest(range(CAST(ceil(min(bin) * 0.25) AS BIGINT), CAST(floor((max(bin) + 1) * 0.25) AS BIGINT) + 1)) AS p FROM m),
w AS (SELECT p, m.*, pow(1 - pow(abs((bin + 0.5) * 0.25 - p) / 3, 3), 3) AS w FROM g JOIN m ON abs((bin + 0.5) * 0.25 - p) < 3),
s AS (SELECT p, sum(n) AS rows_near, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * sxy) AS sxy FROM w GROUP BY 1),
l AS (SELECT *, CASE WHEN sxx / n - sx / n * sx / n > 1e-12 * greatest(sxx / n, 1e-300) THEN (sxy / n - sx / n * sy / n) / (sxx / n - sx / n * sx / n) END AS b FROM s)
SELECT CAST(p AS DOUBLE) AS x, round(coalesce(sy / n + b * (p - sx / n), sy / n), 4) AS fitted, CAST(rows_near AS BIGINT) AS rows_near FROM l"""


@query(
    "temperature_local_line",
    f"WITH {FEATURES}, rows AS (SELECT temperature_2m AS x, CAST(nd_mw AS DOUBLE) AS y FROM features), {_LINE}",
)
def temperature_local_line(spark, sf):
    """Demand against temperature as a local regression on whole degrees."""
    line = smooth.local_line(roles.feature_rows(spark, sf), "temperature_2m", "nd_mw")
    return rounded(line.select("x", "fitted", "rows_near"), 4)
