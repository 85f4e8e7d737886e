"""Bi-temporal queries over the outage log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import textfn
from tidemark.operators import bitemporal, checks, extract
from tidemark.plans import features as plans
from tidemark.plans import reports
from tidemark.session import stage
from workload import query, roles
from workload.roles import FEATURES, OUTAGE_LOG, OUTAGE_LOG_JANUARY, ntz, rounded
from workload.series import (
    _F32,
    _STAMPS,
    JANUARY_HOLIDAYS,
    calendar_sql,
    january_holidays,
    stamp,
    weather_only,
)

AS_OF = "TIMESTAMP '1998-07-01'"
_KNOWN = f"""known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mrid ORDER BY revision_number DESC) AS rn
FROM log WHERE published_at <= {AS_OF}) WHERE rn = 1 AND message_status <> 'Withdrawn')"""


@query(
    "outages_as_of",
    f"WITH {OUTAGE_LOG}, {_KNOWN} SELECT mrid, revision_number, message_status, published_at, effective_from, effective_to, affected_mw FROM known",
)
def outages_as_of(spark, sf):
    known = bitemporal.as_of(roles.outage_log(spark, sf), stamp("1998-07-01"))
    return ntz(
        known.select(
            "mrid", "revision_number", "message_status", "published_at", "effective_from",
            "effective_to", "affected_mw",
        )
    )


@query(
    "outages_active_as_of",
    f"""WITH {OUTAGE_LOG}, {_KNOWN} SELECT mrid, revision_number, effective_from, effective_to FROM known
WHERE effective_from <= {AS_OF} AND (effective_to IS NULL OR effective_to > {AS_OF})""",
)
def outages_active_as_of(spark, sf):
    t = stamp("1998-07-01")
    active = bitemporal.active_at(bitemporal.as_of(roles.outage_log(spark, sf), t), t)
    return ntz(active.select("mrid", "revision_number", "effective_from", "effective_to"))


@query(
    "latest_revision",
    f"""WITH {OUTAGE_LOG} SELECT mrid, revision_number, message_status FROM log
QUALIFY row_number() OVER (PARTITION BY mrid ORDER BY revision_number DESC) = 1""",
)
def latest_revision(spark, sf):
    log = roles.outage_log(spark, sf).select("mrid", "revision_number", "message_status")
    return bitemporal.latest_revision(log)


@query(
    "revision_visibility",
    f"""WITH {OUTAGE_LOG} SELECT mrid, revision_number, published_at AS visible_from,
min(published_at) OVER (PARTITION BY mrid ORDER BY revision_number DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visible_to FROM log""",
)
def revision_visibility(spark, sf):
    seen = bitemporal.visibility(roles.outage_log(spark, sf))
    return ntz(seen.select("mrid", "revision_number", "visible_from", "visible_to"))


# The plain form: every month start against every row known by then.
_MONTHLY = f"""WITH {OUTAGE_LOG},
months AS (SELECT unnest(generate_series(date_trunc('month', min(published_at))::TIMESTAMP, date_trunc('month', date_trunc('day', max(published_at) + INTERVAL 31 DAY))::TIMESTAMP, INTERVAL 1 MONTH)) AS t FROM log),
known AS (SELECT t, mrid, max(revision_number) AS revision_number FROM months JOIN log ON published_at <= t GROUP BY 1, 2),
active AS (SELECT t, log.* FROM known JOIN log USING (mrid, revision_number)
WHERE message_status <> 'Withdrawn' AND effective_from <= t AND (effective_to IS NULL OR effective_to > t))"""


@query(
    "outages_active_each_month",
    _MONTHLY + " SELECT t AS month, mrid, revision_number FROM active",
)
def outages_active_each_month(spark, sf):
    log = roles.outage_log(spark, sf)
    active = bitemporal.active_on(log, bitemporal.month_bounds(log), "1 month", "month")
    return ntz(active.select("month", "mrid", "revision_number"))


@query(
    "fuel_mix_monthly",
    _MONTHLY
    + " SELECT t AS month, coalesce(fuel_type, 'Unknown') AS fuel_type, coalesce(sum(affected_mw), 0e0) AS total_mw FROM active GROUP BY 1, 2",
)
def fuel_mix_monthly(spark, sf):
    return ntz(bitemporal.fuel_mix(roles.outage_log(spark, sf)))


@query(
    "fuel_mix_pivot",
    _MONTHLY
    + " SELECT t AS month, "
    + ", ".join(
        f"coalesce(sum(affected_mw) FILTER (WHERE coalesce(fuel_type, 'Unknown') = '{f}'), 0e0) AS \"{f}\""
        for f in ("Gas", "Wind", "Nuclear", "Coal", "Unknown")
    )
    + " FROM active GROUP BY 1",
)
def fuel_mix_pivot(spark, sf):
    mix = bitemporal.fuel_mix(roles.outage_log(spark, sf))
    return ntz(bitemporal.fuel_mix_wide(mix, ("Gas", "Wind", "Nuclear", "Coal", "Unknown")))


_VALIDITY = """validity AS (SELECT *, published_at AS valid_from,
lead(published_at) OVER (PARTITION BY mrid ORDER BY published_at, revision_number) AS valid_to FROM log)"""


@query(
    "revision_validity",
    f"WITH {OUTAGE_LOG}, {_VALIDITY} SELECT mrid, revision_number, valid_from, valid_to FROM validity",
)
def revision_validity(spark, sf):
    spans = bitemporal.revision_validity(roles.outage_log(spark, sf))
    return ntz(spans.select("mrid", "revision_number", "valid_from", "valid_to"))


@query(
    "active_contribution_windows",
    f"""WITH {OUTAGE_LOG}, {_VALIDITY}, f AS (SELECT TIMESTAMP '2002-01-01' AS far)
SELECT mrid, revision_number, greatest(valid_from, effective_from) AS window_from, least(coalesce(valid_to, far), coalesce(effective_to, far)) AS window_to
FROM validity, f WHERE message_status <> 'Withdrawn' AND greatest(valid_from, effective_from) < least(coalesce(valid_to, far), coalesce(effective_to, far))""",
)
def active_contribution_windows(spark, sf):
    known = bitemporal.known_stretches(roles.outage_log(spark, sf))
    out = bitemporal.active_windows(known, stamp("2002-01-01"))
    return ntz(out.select("mrid", "revision_number", "window_from", "window_to"))


@query(
    "forward_contribution_windows",
    f"""WITH {OUTAGE_LOG}, {_VALIDITY}, f AS (SELECT TIMESTAMP '2002-01-01' AS far)
SELECT mrid, revision_number, greatest(valid_from, effective_from - INTERVAL 240 HOUR) AS window_from, least(coalesce(valid_to, far), effective_from) AS window_to
FROM validity, f WHERE message_status <> 'Withdrawn' AND greatest(valid_from, effective_from - INTERVAL 240 HOUR) < least(coalesce(valid_to, far), effective_from)""",
)
def forward_contribution_windows(spark, sf):
    known = bitemporal.known_stretches(roles.outage_log(spark, sf))
    out = bitemporal.forward_windows(known, stamp("2002-01-01"), 240)
    return ntz(out.select("mrid", "revision_number", "window_from", "window_to"))


# The plain form of the roll-up: windows against every hour of the grid.
def _rollup_sql(grid: str, hours: int) -> str:
    return f"""{_VALIDITY},
far AS (SELECT max(timestamp_utc) + INTERVAL 2 HOUR AS far FROM {grid}),
live AS (SELECT *, coalesce(valid_to, far) AS vt, coalesce(effective_to, far) AS et, coalesce(affected_mw, 0e0) AS mw,
 CASE WHEN lower(coalesce(cause, '')) = 'unplanned' THEN 1 ELSE 0 END AS unpl FROM validity, far WHERE message_status <> 'Withdrawn'),
act AS (SELECT g.timestamp_utc, sum(mw) AS mw, sum(unpl) AS n FROM {grid} g JOIN live ON greatest(valid_from, effective_from) <= g.timestamp_utc AND least(vt, et) > g.timestamp_utc GROUP BY 1),
fwd AS (SELECT g.timestamp_utc, sum(mw) AS mw FROM {grid} g JOIN live ON greatest(valid_from, effective_from - INTERVAL {hours} HOUR) <= g.timestamp_utc AND least(vt, effective_from) > g.timestamp_utc GROUP BY 1),
rollup AS (SELECT g.timestamp_utc, CAST(coalesce(act.mw, 0) AS DOUBLE) AS remit_unavail_mw_total, CAST(coalesce(act.n, 0) AS INTEGER) AS remit_active_unplanned_count,
CAST(coalesce(fwd.mw, 0) AS DOUBLE) AS remit_unavail_mw_next_24h FROM {grid} g LEFT JOIN act USING (timestamp_utc) LEFT JOIN fwd USING (timestamp_utc))"""


_EVENT_HOURS = "hours AS (SELECT DISTINCT date_trunc('hour', ts) AS timestamp_utc FROM events)"


@query(
    "outage_hourly_rollup",
    f"WITH {OUTAGE_LOG_JANUARY}, {_EVENT_HOURS}, {_rollup_sql('hours', 24)} SELECT * FROM rollup",
)
def outage_hourly_rollup(spark, sf):
    hour = F.date_trunc("hour", F.col("ts")).alias("timestamp_utc")
    grid = roles.table(spark, sf, "events").select(hour).distinct()
    out = bitemporal.outage_rollup(roles.outage_log(spark, sf, january=True), grid, 24)
    return ntz(rounded(out))


_EXTRACTED = """extracted AS (SELECT mrid, revision_number, CASE WHEN revision_number % 4 = 0 THEN CAST(revision_number % 500 AS DOUBLE) END AS affected_capacity_mw
FROM log WHERE revision_number % 3 = 0)"""


def extracted(log):
    return log.filter(F.col("revision_number") % 3 == 0).select(
        "mrid",
        "revision_number",
        F.when(
            F.col("revision_number") % 4 == 0, (F.col("revision_number") % 500).cast("double")
        ).alias("affected_capacity_mw"),
    )


@query(
    "capacity_override",
    f"""WITH {OUTAGE_LOG}, {_EXTRACTED} SELECT mrid, revision_number, coalesce(affected_capacity_mw, affected_mw) AS affected_mw
FROM log LEFT JOIN extracted USING (mrid, revision_number)""",
)
def capacity_override(spark, sf):
    log = roles.outage_log(spark, sf)
    return bitemporal.override_capacity(log, extracted(log)).select(
        "mrid", "revision_number", "affected_mw"
    )


@query(
    "feature_table_with_outages",
    f"""WITH {FEATURES}, {JANUARY_HOLIDAYS}, {OUTAGE_LOG_JANUARY.replace("log AS", "raw_log AS")},
extracted AS (SELECT mrid, revision_number, CASE WHEN revision_number % 4 = 0 THEN CAST(revision_number % 500 AS DOUBLE) END AS affected_capacity_mw FROM raw_log WHERE revision_number % 3 = 0),
log AS (SELECT raw_log.* REPLACE (coalesce(affected_capacity_mw, affected_mw) AS affected_mw) FROM raw_log LEFT JOIN extracted USING (mrid, revision_number)),
{_rollup_sql("features", 24)}
{calendar_sql("features", "timestamp_utc, nd_mw, tsd_mw, " + _F32 + ", " + _STAMPS)},
TIMESTAMP '2024-02-03' AS holidays_retrieved_at_utc, remit_unavail_mw_total, remit_active_unplanned_count, remit_unavail_mw_next_24h,
TIMESTAMP '2024-02-04' AS remit_retrieved_at_utc FROM walled JOIN rollup USING (timestamp_utc)""",
)
def feature_table_with_outages(spark, sf):
    base = stage(
        plans.weather_calendar(
            weather_only(spark, sf), january_holidays(spark), stamp("2024-02-03")
        )
    )
    log = roles.outage_log(spark, sf, january=True)
    full = plans.with_outages(base, log, extracted(log), 24, stamp("2024-02-04"), validate=False)
    return ntz(rounded(full, 3))


@query(
    "unplanned_tag_match",
    f"WITH {OUTAGE_LOG} SELECT mrid, revision_number, lower(coalesce(cause, '')) = 'unplanned' AS unplanned FROM log",
)
def unplanned_tag_match(spark, sf):
    log = roles.outage_log(spark, sf)
    return log.select("mrid", "revision_number", bitemporal.is_unplanned("cause").alias("unplanned"))


@query(
    "unknown_status_counts",
    "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1",
)
def unknown_status_counts(spark, sf):
    return checks.unknown_values(roles.table(spark, sf, "orders"), "o_orderstatus", ("O", "F"))


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return checks.duplicate_keys(roles.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# Labelled answers for a third of the messages, off by various amounts.
_LABELS = """labels_set AS (SELECT mrid, revision_number, coalesce(event_type, 'Other') AS event_type, coalesce(fuel_type, 'Gas') AS fuel_type,
 affected_mw + (revision_number % 13) - 6 AS affected_capacity_mw, effective_from + to_minutes((revision_number % 5) * 30) AS effective_from, effective_to,
 CAST(0.9 AS FLOAT) AS confidence FROM log WHERE revision_number % 3 = 0)"""


def label_set(log):
    r = F.col("revision_number")
    return log.filter(r % 3 == 0).select(
        "mrid",
        "revision_number",
        F.coalesce("event_type", F.lit("Other")).alias("event_type"),
        F.coalesce("fuel_type", F.lit("Gas")).alias("fuel_type"),
        (F.col("affected_mw") + (r % 13) - 6).alias("affected_capacity_mw"),
        F.timestamp_micros(
            F.unix_micros("effective_from") + (r % 5).cast("bigint") * 1_800_000_000
        ).alias("effective_from"),
        "effective_to",
        F.lit(0.9).cast("float").alias("confidence"),
    )


@query(
    "label_lookup_extraction",
    f"""WITH {OUTAGE_LOG}, {_LABELS}
SELECT log.mrid AS mrid, log.revision_number AS revision_number,
CASE WHEN l.mrid IS NOT NULL THEN l.event_type ELSE coalesce(log.event_type, 'Other') END AS event_type,
CASE WHEN l.mrid IS NOT NULL THEN l.fuel_type ELSE coalesce(log.fuel_type, 'Other') END AS fuel_type,
l.affected_capacity_mw AS affected_capacity_mw,
CASE WHEN l.mrid IS NOT NULL THEN l.effective_from ELSE log.effective_from END AS effective_from,
CASE WHEN l.mrid IS NOT NULL THEN l.effective_to ELSE log.effective_to END AS effective_to,
round(CAST(coalesce(l.confidence, 0) AS DOUBLE), 3) AS confidence, CAST(NULL AS VARCHAR) AS prompt_hash, CAST(NULL AS VARCHAR) AS model_id,
TIMESTAMP '2024-02-01' AS extracted_at_utc
FROM log LEFT JOIN labels_set l ON l.mrid = log.mrid AND l.revision_number = log.revision_number""",
)
def label_lookup_extraction(spark, sf):
    log = roles.outage_log(spark, sf)
    extractor = extract.LabelExtractor(label_set(log))
    return ntz(rounded(extract.extracted_table(log, extractor, stamp("2024-02-01")), 3))


# What a simple reader of the raw fields says, scored against the labels.
class RawFields:
    def extract(self, log):
        return log.select(
            "mrid",
            "revision_number",
            F.coalesce("event_type", F.lit("Other")).alias("event_type"),
            F.coalesce("fuel_type", F.lit("Other")).alias("fuel_type"),
            F.col("affected_mw").alias("affected_capacity_mw"),
            "effective_from",
            F.when(F.col("revision_number") % 2 == 0, F.col("effective_to")).alias("effective_to"),
        )


_SCORED = f"""WITH {OUTAGE_LOG}, {_LABELS},
raw AS (SELECT mrid, revision_number, coalesce(event_type, 'Other') AS event_type, coalesce(fuel_type, 'Other') AS fuel_type, affected_mw AS affected_capacity_mw,
 effective_from, CASE WHEN revision_number % 2 = 0 THEN effective_to END AS effective_to FROM log),
pairs AS (SELECT e.mrid, e.revision_number, e.event_type AS e1, a.event_type AS a1, e.fuel_type AS e2, a.fuel_type AS a2, e.affected_capacity_mw AS e3, a.affected_capacity_mw AS a3,
 e.effective_from AS e4, a.effective_from AS a4, e.effective_to AS e5, a.effective_to AS a5 FROM labels_set e JOIN raw a USING (mrid, revision_number)),
scored AS (
 SELECT mrid, revision_number, 1 AS pos, 'event_type' AS field, e1 IS NOT DISTINCT FROM a1 AS exact, e1 IS NOT DISTINCT FROM a1 AS close FROM pairs
 UNION ALL SELECT mrid, revision_number, 2, 'fuel_type', e2 IS NOT DISTINCT FROM a2, e2 IS NOT DISTINCT FROM a2 FROM pairs
 UNION ALL SELECT mrid, revision_number, 3, 'affected_capacity_mw', e3 IS NOT DISTINCT FROM a3, (e3 IS NULL AND a3 IS NULL) OR coalesce(abs(e3 - a3) <= 5, false) FROM pairs
 UNION ALL SELECT mrid, revision_number, 4, 'effective_from', e4 IS NOT DISTINCT FROM a4, (e4 IS NULL AND a4 IS NULL) OR coalesce(abs(epoch(e4) - epoch(a4)) <= 3600, false) FROM pairs
 UNION ALL SELECT mrid, revision_number, 5, 'effective_to', e5 IS NOT DISTINCT FROM a5, (e5 IS NULL AND a5 IS NULL) OR coalesce(abs(epoch(e5) - epoch(a5)) <= 3600, false) FROM pairs)"""


def _report(spark, sf):
    log = roles.outage_log(spark, sf)
    return reports.extraction_report(log, label_set(log), RawFields())


@query(
    "extraction_agreement",
    _SCORED
    + " SELECT field, count(*) AS total, count(*) FILTER (WHERE exact) AS exact_match, count(*) FILTER (WHERE close) AS tolerance_match FROM scored GROUP BY 1",
)
def extraction_agreement(spark, sf):
    return _report(spark, sf)["agreement"]


@query(
    "first_disagreements",
    _SCORED
    + " SELECT mrid, revision_number, field FROM scored WHERE NOT close ORDER BY mrid, revision_number, pos LIMIT 10",
)
def first_disagreements(spark, sf):
    return _report(spark, sf)["first"].select("mrid", "revision_number", "field")


@query(
    "more_disagreements",
    _SCORED + " SELECT greatest(count(*) - 10, 0) AS n_more FROM scored WHERE NOT close",
)
def more_disagreements(spark, sf):
    return _report(spark, sf)["more"]


@query(
    "embeddable_text",
    f"""WITH {OUTAGE_LOG} SELECT mrid || '::' || CAST(revision_number AS VARCHAR) AS id,
coalesce(nullif(trim(message_description), ''), concat_ws(' ', event_type, cause, fuel_type, affected_unit)) AS text FROM log""",
)
def embeddable_text(spark, sf):
    return roles.outage_log(spark, sf).select(
        textfn.composite_id().alias("id"), textfn.embeddable_text().alias("text")
    )
