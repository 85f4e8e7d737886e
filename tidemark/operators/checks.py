"""Assertions, counters and column resolution."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources.contracts import ContractError


class KeyViolation(ValueError):
    """A key that should be unique repeats."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """Fail when a key repeats; only one offender travels to the driver."""
    offender = duplicate_keys(df, keys).limit(1).collect()
    if offender:
        raise KeyViolation(f"{label}: key {offender[0].asDict()} repeats")
    return df


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, validate: str
) -> DataFrame:
    """Join with a cardinality contract: one_to_one or many_to_one."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality {validate!r}")
    assert_unique(right, on, "right side")
    if validate == "one_to_one":
        assert_unique(left, on, "left side")
    return left.join(right, list(on), how)


def unknown_values(df: DataFrame, column: str, vocabulary: Iterable[str]) -> DataFrame:
    """Values outside a closed vocabulary with their counts; rows are kept elsewhere."""
    return (
        df.filter(~F.col(column).isin(*vocabulary))
        .groupBy(column)
        .agg(F.count("*").alias("n"))
    )


def fill_counters(columns: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]


def observe_counts(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """Data-quality counters that ride along with the action, no extra pass."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, distinct values, min and max per column, in long form.

    One partial aggregate per (column, value), so a hot value is combined
    before the shuffle.
    """
    pairs = df.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                )
            )
        ).alias("e")
    ).select("e.*")
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def resolve_features(df: DataFrame, features: Sequence[str] | None = None) -> tuple[str, ...]:
    """Explicit features, else the five weather columns; a missing one is an error."""
    resolved = tuple(schemas.WEATHER_COLUMNS if features is None else features)
    missing = [c for c in resolved if c not in df.columns]
    if missing:
        raise ContractError(f"feature column(s) missing: {missing}")
    return resolved


def feature_set_columns(name: str, drop_forward: bool = False) -> tuple[str, ...]:
    """Model columns of one named feature set: no time, target or provenance."""
    if name not in schemas.FEATURE_SETS:
        raise ContractError(f"unknown feature set {name!r}")
    columns = [
        c
        for c in schemas.FEATURE_SETS[name].names
        if not c.endswith("_utc") and c not in schemas.DEMAND_COLUMNS
    ]
    if drop_forward:
        columns = [c for c in columns if c != "remit_unavail_mw_next_24h"]
    return tuple(columns)


def single_active(**feature_sets: object | None) -> str:
    """Exactly one feature set may be configured."""
    active = [name for name, value in feature_sets.items() if value is not None]
    if len(active) != 1:
        raise ContractError(f"exactly one feature set must be active, got {active}")
    return active[0]


def time_slice(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Rows in [start, end]; reaches the scan as a pushed filter for literals."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= end))


def last_days(df: DataFrame, ts: str, days: int) -> DataFrame:
    """The last days of a series."""
    newest = df.agg(F.max(ts).alias("m")).scalar()
    return df.filter(F.col(ts) > newest - F.expr(f"INTERVAL {int(days)} DAYS"))
