"""Runs as rows of a table: register, describe, rank."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_FRAGMENT = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")
RUN_SCHEMA = (
    "run_id string, name string, type string, feature_set string, target string, "
    "feature_columns array<string>, fit_utc timestamp, git_sha string, "
    "hyperparameters map<string,string>, "
    "metrics map<string,struct<mean:double,std:double,per_fold:array<double>>>, "
    "registered_at_utc timestamp"
)


class UnknownRun(LookupError):
    """No run has this id."""


def run_id(name: Column, fit_utc: Column) -> Column:
    """``{name}_{yyyyMMddTHHmm}`` at minute precision, UTC."""
    return F.concat(name, F.lit("_"), F.date_format(fit_utc, "yyyyMMdd'T'HHmm"))


def check_run_id(value: str) -> str:
    """An id must be one path fragment."""
    if not RUN_FRAGMENT.match(value) or ".." in value:
        raise ValueError(f"not a run id: {value!r}")
    return value


def summarise(per_fold: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``metrics`` map of {mean, sample std, values in fold order}.

    One value per fold and metric; the list is as long as the run has folds.
    """
    def summary(n: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct("fold_index", n)))
        return F.struct(
            F.avg(n).alias("mean"),
            F.stddev_samp(n).alias("std"),
            F.transform(listed, lambda r: r[n]).alias("per_fold"),
        )

    pairs = [part for n in names for part in (F.lit(n), summary(n))]
    return per_fold.groupBy(*by).agg(F.create_map(*pairs).alias("metrics"))


def run_row(
    summary: DataFrame,
    name: str,
    kind: str,
    feature_set: str,
    target: str,
    feature_columns: Sequence[str],
    fit_utc: Column,
    hyperparameters: dict[str, str] | None = None,
    git_sha: str | None = None,
) -> DataFrame:
    """One registry row from a metrics summary."""
    pairs = [F.lit(p) for kv in (hyperparameters or {}).items() for p in kv]
    empty = F.create_map().cast("map<string,string>")
    return summary.select(
        run_id(F.lit(name), fit_utc).alias("run_id"),
        F.lit(name).alias("name"),
        F.lit(kind).alias("type"),
        F.lit(feature_set).alias("feature_set"),
        F.lit(target).alias("target"),
        F.array(*(F.lit(c) for c in feature_columns)).cast("array<string>").alias("feature_columns"),
        fit_utc.alias("fit_utc"),
        F.lit(git_sha).cast("string").alias("git_sha"),
        (F.create_map(*pairs) if pairs else empty).alias("hyperparameters"),
        "metrics",
        F.current_timestamp().alias("registered_at_utc"),
    )


def register(row: DataFrame, path: str) -> None:
    """Append runs to the registry table."""
    row.write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def describe(table: DataFrame, wanted: str) -> DataFrame:
    """The row of one run; an unknown id is an error."""
    found = table.filter(F.col("run_id") == check_run_id(wanted))
    if not found.take(1):
        raise UnknownRun(f"no run {wanted!r}")
    return found


def leaderboard(
    table: DataFrame,
    target: str | None = None,
    kind: str | None = None,
    feature_set: str | None = None,
    sort_by: str | None = "mae",
    ascending: bool = True,
) -> DataFrame:
    """Exact-match filters, then order by a metric mean; missing or NaN go last, and ties by name."""
    out = table
    for column, wanted in (("target", target), ("type", kind), ("feature_set", feature_set)):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    if sort_by is None:
        return out
    mean = F.col("metrics")[sort_by]["mean"]
    missing = mean.isNull() | F.isnan(mean)
    known = F.when(~missing, mean)
    return out.orderBy(missing.asc(), known.asc() if ascending else known.desc(), F.asc("name"))


def latest_run(
    table: DataFrame,
    feature_set: str,
    name_contains: str | None = None,
    with_column: str | None = None,
    without_column: str | None = None,
) -> DataFrame:
    """The latest matching run; no row when nothing matches."""
    out = table.filter(F.col("feature_set") == feature_set)
    if name_contains is not None:
        out = out.filter(F.col("name").contains(name_contains))
    if with_column is not None:
        out = out.filter(F.array_contains("feature_columns", with_column))
    if without_column is not None:
        out = out.filter(~F.array_contains("feature_columns", without_column))
    return (
        out.agg(F.max_by(F.struct(*out.columns), F.struct("fit_utc", "run_id")).alias("r"))
        .filter("r is not null")
        .select("r.*")
    )


def protocol_signature() -> Column:
    """What two runs must share to be compared: type, target, number of folds."""
    first = F.get(F.map_values("metrics"), F.lit(0))
    folds = F.when(F.size("metrics") > 0, F.size(first["per_fold"])).otherwise(0)
    return F.struct(F.col("type"), F.col("target"), folds.alias("n_folds"))


def comparability(table: DataFrame) -> DataFrame:
    """Number of distinct evaluation protocols among the runs; 1 means comparable."""
    return table.agg(F.count_distinct(protocol_signature()).alias("n_protocols")).withColumn(
        "comparable", F.col("n_protocols") <= 1
    )
