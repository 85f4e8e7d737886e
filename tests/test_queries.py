"""Registered queries run on small tables and agree with their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, canonical

# Needs a gap-free event series, so not the smallest tables.
SF = "/root/testdata/sf0.01"
CHECKED = (
    "feature_table_weather_calendar",
    "outage_hourly_rollup",
    "outages_active_each_month",
    "revision_visibility",
    "backtest_metrics_naive",
    "fold_parameters_sliding",
    "benchmark_comparison",
    "cosine_top_k",
    "extraction_agreement",
    "byte_pair_counts",
    "demand_feed_rows",
    "stream_current_state",
)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark):
    out = entry.entry(spark)
    assert len(out.columns) == 56 + 6
    assert out.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


PLAIN = (
    "hourly_demand_mean",
    "station_weighted_mean",
    "outages_as_of",
    "fuel_mix_monthly",
    "pretoken_counts",
    "calendar_columns",
    "step_lookup",
)


@pytest.mark.parametrize("name", PLAIN)
def test_plans_stay_on_the_jvm_and_prune(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
