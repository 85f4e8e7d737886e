"""Drift, rolling error and exact quantile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import drift, quantiles
from tidemark.session import stage_table
from workload import query, roles
from workload.roles import FEATURES, ntz, rounded

ITEM_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
REFERENCE_YEAR = 1997

_ITEMS = "items AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, year(l_shipdate) AS "window", CAST({c} AS DOUBLE) AS value FROM lineitem""" for c in ITEM_FEATURES
) + f"""), ref AS (SELECT feature, value FROM items WHERE "window" <= {REFERENCE_YEAR}), cur AS (SELECT * FROM items WHERE "window" > {REFERENCE_YEAR})"""
_HOURS = f"{FEATURES}, items AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(floor(epoch(timestamp_utc) / 604800) AS BIGINT) AS "window", CAST({c} AS DOUBLE) AS value FROM features"""
    for c in ("nd_mw", *schemas.WEATHER_COLUMNS)
) + """), first_weeks AS (SELECT min("window") + 1 AS w FROM items), ref AS (SELECT feature, value FROM items, first_weeks WHERE "window" <= w), cur AS (SELECT items.* FROM items, first_weeks WHERE "window" > w)"""

_LEVELS = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
_DRIFT = f"""edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_LEVELS}))) AS e FROM ref GROUP BY 1),
rb AS (SELECT feature, len(list_filter(e, lambda x: x < value)) AS bin FROM ref JOIN edges USING (feature) WHERE value IS NOT NULL),
p AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM rb GROUP BY 1, 2),
cb AS (SELECT feature, "window", len(list_filter(e, lambda x: x < value)) AS bin FROM cur JOIN edges USING (feature) WHERE value IS NOT NULL),
n AS (SELECT feature, "window", count(*) AS n FROM cb GROUP BY 1, 2),
q AS (SELECT feature, "window", bin, count(*) AS k FROM cb GROUP BY 1, 2, 3),
slots AS (SELECT feature, "window", n, unnest(range(len(e) + 1)) AS bin FROM n JOIN edges USING (feature)),
s AS (SELECT feature, "window", n, coalesce(p, 0) AS p, coalesce(k, 0) / n AS q FROM slots LEFT JOIN p USING (feature, bin) LEFT JOIN q USING (feature, "window", bin))
SELECT feature, "window", any_value(n) AS n, {{}} FROM s GROUP BY 1, 2"""
_PSI = f"round(sum((greatest(q, {drift.LEAST_SHARE}) - greatest(p, {drift.LEAST_SHARE})) * ln(greatest(q, {drift.LEAST_SHARE}) / greatest(p, {drift.LEAST_SHARE}))), 6) AS psi"
_OVERLAP = "round(sum(least(p, q)), 6) AS overlap"
_KS = """u AS (SELECT feature, "window", value FROM cur WHERE value IS NOT NULL UNION ALL
      SELECT feature, w."window", value FROM ref JOIN (SELECT DISTINCT feature, "window" FROM cur WHERE value IS NOT NULL) w USING (feature) WHERE value IS NOT NULL),
v AS (SELECT DISTINCT feature, "window", value FROM u),
c AS (SELECT feature, "window", value, count(*) AS k FROM cur GROUP BY 1, 2, 3), r AS (SELECT feature, value, count(*) AS k FROM ref GROUP BY 1, 2),
g AS (SELECT v.feature, v."window", sum(coalesce(c.k, 0)) OVER o AS a, sum(coalesce(c.k, 0)) OVER a AS n, sum(coalesce(r.k, 0)) OVER o AS b, sum(coalesce(r.k, 0)) OVER a AS m
      FROM v LEFT JOIN c USING (feature, "window", value) LEFT JOIN r ON r.feature = v.feature AND r.value = v.value
      WINDOW o AS (PARTITION BY v.feature, v."window" ORDER BY v.value), a AS (PARTITION BY v.feature, v."window"))
SELECT feature, "window", CAST(max(n) AS BIGINT) AS n, CAST(max(m) AS BIGINT) AS n_reference, round(max(abs(a / n - b / m)), 9) AS ks FROM g GROUP BY 1, 2"""


def items(spark, sf):
    """Line items by year of shipment: the reference and the later years."""
    rows = drift.long_form(roles.table(spark, sf, "lineitem"), ITEM_FEATURES, F.year("l_shipdate").cast("long"))
    rows = stage_table(rows, "items")
    return rows.where(F.col("window") <= REFERENCE_YEAR).drop("window"), rows.where(F.col("window") > REFERENCE_YEAR)


def weeks(spark, sf):
    """The hourly feature table by week: the first two weeks and the later ones."""
    hours = roles.feature_rows(spark, sf)
    week = F.floor(F.unix_micros("timestamp_utc") / (7 * drift.DAY_MICROS))
    rows = stage_table(drift.long_form(hours, ["nd_mw", *schemas.WEATHER_COLUMNS], week), "weeks")
    first = rows.agg(F.min("window") + 1).scalar()
    return rows.where(F.col("window") <= first).drop("window"), rows.where(F.col("window") > first)


@query("population_stability", f"WITH {_ITEMS}, {_DRIFT.format(_PSI)}")
def population_stability(spark, sf):
    return rounded(drift.distribution_drift(*items(spark, sf)).select("feature", "window", "n", "psi"))


@query("histogram_overlap", f"WITH {_HOURS}, {_DRIFT.format(_OVERLAP)}")
def histogram_overlap(spark, sf):
    return rounded(drift.distribution_drift(*weeks(spark, sf)).select("feature", "window", "n", "overlap"))


@query("feature_ks_by_year", f"WITH {_ITEMS}, {_KS}")
def feature_ks_by_year(spark, sf):
    return rounded(drift.ks_distance(*items(spark, sf)), 9)


@query("feature_ks_by_week", f"WITH {_HOURS}, {_KS}")
def feature_ks_by_week(spark, sf):
    return rounded(drift.ks_distance(*weeks(spark, sf)), 9)


def _rolled(days):
    frame = f"RANGE BETWEEN INTERVAL '{days * 86_400_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW"
    over = f"OVER (PARTITION BY event_type ORDER BY ts {frame})"
    return f"""round(avg(abs(e)) {over}, 6) AS mae_{days}, round(sqrt(avg(e * e) {over}), 6) AS rmse_{days}, count(e) {over} AS n_{days}"""


ROLLED_DAYS = (1, 7, 28)


@query(
    "rolling_prediction_error",
    f"""WITH m AS (SELECT event_type, round(avg(value), 2) AS p FROM events GROUP BY 1),
o AS (SELECT event_type, date_trunc('minute', ts) AS ts, CASE WHEN user_id % 10 = 3 THEN NULL ELSE (value - p) * 0.7310585786e0 END AS e FROM events JOIN m USING (event_type))
SELECT DISTINCT event_type, ts, {", ".join(_rolled(d) for d in ROLLED_DAYS)} FROM o""",
)
def rolling_prediction_error(spark, sf):
    """Events as irregular observations of their type's mean; some are missing, and many share a minute."""
    events = roles.table(spark, sf, "events")
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("p"))
    seen = F.when(F.col("user_id") % 10 != 3, (F.col("value") - F.col("p")) * 0.7310585786)
    rows = events.join(means, "event_type").select("event_type", F.date_trunc("minute", "ts").alias("ts"), seen.alias("error"))
    return ntz(rounded(drift.rolling_error(rows, ROLLED_DAYS, ["event_type"], "ts")))


@query(
    "exact_quantiles_by_flag",
    """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n_values, round(quantile_cont(l_extendedprice, 0.01), 6) AS p01, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1, 2""",
)
def exact_quantiles_by_flag(spark, sf):
    rows = roles.table(spark, sf, "lineitem")
    found = quantiles.quantiles(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.01, 0.5, 0.99])
    named = (F.col("q")[i].alias(n) for i, n in enumerate(("p01", "p50", "p99")))
    return rounded(found.select("l_returnflag", "l_linestatus", "n_values", *named))
