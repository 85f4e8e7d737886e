"""Calendar, weather mean, fill and outage roll-up on hand-computed rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import timefn
from tidemark.operators import bitemporal, ordered, resample
from tidemark.plans import features as plans
from tidemark.sources.contracts import ContractError, check_contract

UTC = dt.timezone.utc


def ts(text):
    return F.lit(text).cast("timestamp")


def stamped(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def test_feature_sets_are_prefixes():
    widths = [len(s.fields) for s in schemas.FEATURE_SETS.values()]
    assert widths == [10, 56, 60]
    assert schemas.WEATHER_CALENDAR.fields[:10] == schemas.WEATHER_ONLY.fields
    assert schemas.WITH_OUTAGES.fields[:56] == schemas.WEATHER_CALENDAR.fields


def test_settlement_periods_on_clock_changes(spark):
    rows = spark.createDataFrame(
        [("2024-10-27", p) for p in (1, 3, 4, 5, 50)] + [("2024-03-31", p) for p in (1, 3, 46)]
        + [("2024-07-01", 48)],
        "d string, p int",
    )
    out = rows.select(
        "d", "p",
        timefn.settlement_to_utc(F.col("d").cast("date"), "p").cast("string").alias("u"),
    ).collect()
    got = {(r["d"], r["p"]): r["u"] for r in out}
    assert got[("2024-10-27", 3)] == "2024-10-27 00:00:00"
    assert got[("2024-10-27", 4)] == "2024-10-27 00:30:00"
    assert got[("2024-10-27", 5)] == "2024-10-27 01:00:00"
    assert got[("2024-10-27", 50)] == "2024-10-27 23:30:00"
    assert got[("2024-03-31", 3)] == "2024-03-31 01:00:00"
    assert got[("2024-03-31", 46)] == "2024-03-31 22:30:00"
    assert got[("2024-07-01", 48)] == "2024-07-01 22:30:00"


@pytest.mark.parametrize("day,period", [("2024-03-31", 47), ("2024-10-27", 51), ("2024-07-01", 49), ("2024-07-01", 0)])
def test_settlement_period_out_of_range(spark, day, period):
    row = spark.createDataFrame([(day, period)], "d string, p int")
    with pytest.raises(Exception, match="out of range"):
        row.select(timefn.settlement_to_utc(F.col("d").cast("date"), "p")).collect()


def test_hourly_mean_rounds_half_even(spark):
    rows = stamped(
        spark.createDataFrame(
            [("2024-01-01 00:00:00", 2, 1), ("2024-01-01 00:30:00", 3, 2), ("2024-01-01 01:00:00", 7, 9)],
            "timestamp_utc string, nd_mw int, tsd_mw int",
        ),
        "timestamp_utc",
    )
    out = {r[0].hour: (r[1], r[2]) for r in resample.hourly_demand(rows).collect()}
    assert out == {0: (2, 2), 1: (7, 9)}
    assert {r[1] for r in resample.hourly_demand(rows, "max").collect()} == {3, 7}
    with pytest.raises(ValueError):
        resample.hourly_demand(rows, "sum")
    with pytest.raises(ContractError):
        resample.hourly_demand(rows.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp_ntz")))


def test_station_mean_truth(spark):
    """Weights 8, 2, 2, 1 over four stations; one unweighted station is ignored."""
    rows = stamped(
        spark.createDataFrame(
            [
                ("2024-01-01", "london", 6.0, None),
                ("2024-01-01", "cardiff", 4.0, None),
                ("2024-01-01", "manchester", 2.0, None),
                ("2024-01-01", "glasgow", 2.0, None),
                ("2024-01-01", "paris", 99.0, None),
                ("2024-01-02", "london", None, 1.0),
                ("2024-01-02", "cardiff", 4.0, 1.0),
                ("2024-01-02", "manchester", 1.0, None),
            ],
            "timestamp_utc string, station string, a double, b double",
        ),
        "timestamp_utc",
    )
    weights = {"london": 8, "cardiff": 2, "manchester": 2, "glasgow": 1}
    out = {r[0].day: (r["a"], r["b"]) for r in resample.station_mean(rows, weights, ["a", "b"]).collect()}
    assert out[1] == (pytest.approx(62 / 13), None)
    assert out[2] == (pytest.approx(10 / 4), 1.0)
    with pytest.raises(ContractError):
        resample.station_mean(rows, {"london": 1, "leeds": 1}, ["a"])
    with pytest.raises(ValueError):
        resample.station_mean(rows, {"london": 0}, ["a"])


def test_constant_weather_stays_constant(spark):
    rows = spark.range(40).select(
        F.timestamp_seconds((F.col("id") % 10) * 3600).alias("timestamp_utc"),
        F.concat(F.lit("s"), F.floor(F.col("id") / 10).cast("string")).alias("station"),
        F.lit(4.2).alias("a"),
    )
    out = resample.station_mean(rows, {"s0": 3, "s1": 0.5, "s2": 9}, ["a"]).collect()
    assert len(out) == 10
    assert all(r["a"] == pytest.approx(4.2) for r in out)


def test_calendar_on_both_clock_changes(spark):
    hours = stamped(
        spark.createDataFrame(
            [("2024-03-31 00:00:00",), ("2024-03-31 01:00:00",), ("2024-10-27 00:00:00",), ("2024-10-27 01:00:00",), ("2024-06-30 23:30:00",)],
            "timestamp_utc string",
        ),
        "timestamp_utc",
    )
    holidays = spark.createDataFrame(
        [("2024-07-01", d) for d in ("england-and-wales", "scotland")] + [("2000-01-01", "northern-ireland")],
        "date string, division string",
    ).withColumn("date", F.col("date").cast("date"))
    out = plans.with_calendar_columns(hours, holidays)
    assert out.columns == ["timestamp_utc", *schemas.CALENDAR_COLUMNS]
    rows = {r["timestamp_utc"].isoformat(): r.asDict() for r in out.collect()}
    assert [rows[k]["is_dst"] for k in sorted(rows)] == [0, 1, 1, 1, 0]
    late = rows["2024-06-30T23:30:00"]
    assert late["month_07"] == 1 and late["day_of_week_1"] == 0 and late["hour_of_day_23"] == 1
    assert late["is_bank_holiday_ew"] == 1 and late["is_bank_holiday_sco"] == 1
    for r in rows.values():
        assert sum(v for k, v in r.items() if k.startswith("hour_of_day")) <= 1
        assert sum(v for k, v in r.items() if k.startswith("month_")) <= 1


def test_rows_before_the_earliest_holiday_are_zero(spark):
    days = spark.createDataFrame([("2024-04-30",), ("2024-05-02",)], "local_date string").withColumn(
        "local_date", F.col("local_date").cast("date")
    )
    holidays = spark.createDataFrame(
        [("2024-05-01", "england-and-wales"), ("2024-05-01", "scotland")], "date string, division string"
    ).withColumn("date", F.col("date").cast("date"))
    out = {r[0].isoformat(): tuple(r)[1:] for r in plans.holiday_flags(days, holidays).collect()}
    assert out == {"2024-04-30": (0, 0, 0, 0), "2024-05-02": (0, 0, 0, 1)}


def test_fourier_is_periodic_and_keeps_microseconds(spark):
    rows = spark.range(1).select(
        ts("2024-01-01 00:00:00.000001").alias("a"), ts("2024-01-08 00:00:00.000001").alias("b")
    )
    a = timefn.fourier_terms("a", 168, 2, "w")
    b = timefn.fourier_terms("b", 168, 2, "v")
    row = rows.select(*a, *b).first()
    assert row[0:4] == pytest.approx(row[4:8], abs=1e-9)
    assert timefn.fourier_terms("a", 24, 0, "d") == []
    with pytest.raises(ValueError):
        timefn.fourier_terms("a", 24, -1, "d")


LOG = (
    "mrid string, revision_number int, message_status string, published_at string, "
    "effective_from string, effective_to string, cause string, affected_mw double"
)


def outage_log(spark, *rows):
    return stamped(
        spark.createDataFrame(list(rows), LOG), "published_at", "effective_from", "effective_to"
    )


def grid(spark, start, hours):
    return spark.range(hours).select(
        F.timestamp_seconds(F.unix_seconds(ts(start)) + F.col("id") * 3600).alias("timestamp_utc")
    )


def rollup(spark, log, start, hours, n=24):
    out = bitemporal.outage_rollup(log, grid(spark, start, hours), n).collect()
    return {r[0].isoformat(sep=" ", timespec="hours"): tuple(r)[1:] for r in out}


def test_forward_window_edges(spark):
    log = outage_log(
        spark,
        ("A", 0, "Active", "2024-01-01 00:00:00", "2024-01-15 12:00:00", "2024-01-16 00:00:00", "Unplanned", 200.0),
    )
    got = rollup(spark, log, "2024-01-14 00:00:00", 60)
    assert got["2024-01-14 11"] == (0.0, 0, 0.0)
    assert got["2024-01-14 12"] == (0.0, 0, 200.0)
    assert got["2024-01-15 11"] == (0.0, 0, 200.0)
    assert got["2024-01-15 12"] == (200.0, 1, 0.0)
    assert got["2024-01-15 23"] == (200.0, 1, 0.0)
    assert got["2024-01-16 00"] == (0.0, 0, 0.0)
    assert {v[2] for v in rollup(spark, log, "2024-01-14 00:00:00", 60, 0).values()} == {0.0}


def test_nothing_published_later_leaks(spark):
    log = outage_log(
        spark,
        ("A", 0, "Active", "2024-01-01 00:00:00", "2024-01-02 00:00:00", None, None, 100.0),
        ("A", 1, "Active", "2024-01-02 05:30:00", "2024-01-02 00:00:00", None, None, 40.0),
    )
    got = rollup(spark, log, "2024-01-02 00:00:00", 10)
    assert got["2024-01-02 05"][0] == 100.0
    assert got["2024-01-02 06"][0] == 40.0


def test_withdrawal_ends_and_null_mw_still_counts(spark):
    log = outage_log(
        spark,
        ("A", 0, "Active", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, "unPlanned", None),
        ("A", 1, "Withdrawn", "2024-01-02 00:00:00", "2024-01-01 00:00:00", None, "Unplanned", None),
        ("B", 0, "Cancelled", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, "Forced", 7.0),
    )
    got = rollup(spark, log, "2024-01-01 22:00:00", 4)
    assert got["2024-01-01 23"] == (7.0, 1, 0.0)
    assert got["2024-01-02 00"] == (7.0, 0, 0.0)


def test_two_orders_of_latest(spark):
    """Revision 2 is published before revision 1: the two rules differ."""
    log = outage_log(
        spark,
        ("A", 2, "Active", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None, 2.0),
        ("A", 1, "Active", "2024-01-02 00:00:00", "2024-01-01 00:00:00", None, None, 1.0),
    )
    assert [r["affected_mw"] for r in bitemporal.as_of(log, ts("2024-01-03")).collect()] == [2.0]
    assert rollup(spark, log, "2024-01-03 00:00:00", 1)["2024-01-03 00"][0] == 1.0
    seen = {r["revision_number"]: r["visible_to"] for r in bitemporal.visibility(log).collect()}
    assert seen[2] is None and seen[1] == dt.datetime(2024, 1, 1)


def test_published_ties_end_at_once(spark):
    log = outage_log(
        spark,
        ("A", 0, "Active", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None, 1.0),
        ("A", 1, "Active", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None, 2.0),
        ("A", 2, "Active", "2024-01-05 00:00:00", "2024-01-01 00:00:00", None, None, 3.0),
    )
    for cut in (None, ordered.width(ordered.DAY_MICROS)):
        rows = bitemporal.revision_validity(log, cut).collect()
        ends = {r["revision_number"]: r["valid_to"] for r in rows}
        assert ends == {0: dt.datetime(2024, 1, 1), 1: dt.datetime(2024, 1, 5), 2: None}


def test_empty_log_gives_zeros(spark):
    empty = spark.createDataFrame([], LOG)
    empty = stamped(empty, "published_at", "effective_from", "effective_to")
    got = rollup(spark, empty, "2024-01-01 00:00:00", 3)
    assert set(got.values()) == {(0.0, 0, 0.0)}


def test_contract_errors_name_the_column(spark):
    df = spark.range(1).select(F.col("id").cast("int").alias("nd_mw"))
    with pytest.raises(ContractError, match="timestamp_utc"):
        check_contract(df, schemas.WEATHER_ONLY)
    good = spark.createDataFrame([], schemas.WEATHER_ONLY)
    with pytest.raises(ContractError, match="unexpected"):
        check_contract(good.withColumn("x", F.lit(1)), schemas.WEATHER_ONLY)
    assert check_contract(good.withColumn("x", F.lit(1)), schemas.WEATHER_ONLY, True).columns == list(schemas.WEATHER_ONLY.names)
    with pytest.raises(ContractError, match="mistyped"):
        check_contract(good.withColumn("nd_mw", F.lit(1.5)), schemas.WEATHER_ONLY)
