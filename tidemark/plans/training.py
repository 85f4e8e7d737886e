"""Backtest models on a feature table, register the runs, compare with a benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import backtest, ordered, registry
from tidemark.session import stage


def prepare(features: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Index the hourly table and stage it: every model reads it several times.

    The table is staged before it is put in order as well, so that what lies
    below it runs once.
    """
    return stage(ordered.row_index(stage(features), ts))


def train_and_register(
    models: Mapping[str, backtest.Forecaster],
    frame: DataFrame,
    split: backtest.RollingOrigin,
    target: str,
    feature_set: str,
    fit_utc: Column,
    names: Sequence[str] = ("mae", "mape", "rmse", "wape"),
    ts: str = "timestamp_utc",
) -> DataFrame:
    """One registry row per model with its metrics over the folds."""
    rows = backtest.count_rows(frame)
    out = None
    for name, model in models.items():
        per_fold, _ = backtest.evaluate(model, frame, split, target, names, ts, rows)
        summary = registry.summarise(per_fold, names)
        row = registry.run_row(
            summary,
            name,
            type(model).__name__,
            feature_set,
            target,
            getattr(model, "features", ()),
            fit_utc,
        )
        out = row if out is None else out.unionByName(row)
    return out


def best_run(table: DataFrame, metric: str = "mae") -> DataFrame:
    """The run with the lowest metric mean: the default model for scoring."""
    mean = F.col("metrics")[metric]["mean"]
    # Equal runs are told apart by their ids.
    rank = F.when(~F.isnan(mean), F.struct(mean.alias("mean"), F.col("run_id").alias("run_id")))
    return table.agg(F.min_by(F.struct(*table.columns), rank).alias("r")).select("r.*")


def score_batch(
    rows: DataFrame,
    coefficients: DataFrame,
    features: Sequence[str],
    run_id: str | None = None,
    intercept: bool = True,
    name: str | None = None,
    target: str | None = None,
    runs: DataFrame | None = None,
) -> DataFrame:
    """Predictions of one stored run: its single coefficient row scores every feature row.

    Without ``run_id`` it is the run of the registry table ``runs`` with the least mean error. Each row logs its request: run, model name, target, and the hash of the features it used.
    """
    from tidemark.functions import textfn
    from tidemark.operators.regress import dot

    if run_id is None:
        default = best_run(runs).first() if runs is not None else None
        if default is None or default["run_id"] is None:
            raise registry.UnknownRun("no run is named, and none has a metric to choose it by")
        run_id = default["run_id"]
    wanted = registry.describe(coefficients, run_id)
    beta = wanted.select("coefficients").scalar()
    return rows.withColumns(
        {
            "prediction": dot(features, beta, intercept),
            "run_id": F.lit(run_id),
            "model_name": F.lit(name),
            "target": F.lit(target),
            "feature_hash": textfn.feature_hash(features),
        }
    )
