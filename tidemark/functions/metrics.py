"""Forecast error metrics as aggregate expressions, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _guarded(y: Column, p: Column, value: Column, *more: tuple[Column, str]) -> Column:
    """The value, or a task error when the group cannot be scored."""
    bad = F.count_if(y.isNull() | p.isNull() | F.isnan(y) | F.isnan(p))
    out = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("metric of zero rows"))).when(
        bad > 0, F.raise_error(F.lit("metric input holds nulls"))
    )
    for test, message in more:
        out = out.when(test, F.raise_error(F.lit(message)))
    return out.otherwise(value).cast("double")


def mae(y: Column, p: Column) -> Column:
    return _guarded(y, p, F.avg(F.abs(y - p)))


def rmse(y: Column, p: Column) -> Column:
    return _guarded(y, p, F.sqrt(F.avg((y - p) * (y - p))))


def mape(y: Column, p: Column) -> Column:
    """A fraction, not a percentage; a zero actual is an error."""
    ratio = F.abs(F.try_divide(y - p, y))
    return _guarded(
        y, p, F.avg(ratio), (F.count_if(y == 0) > 0, "mape is undefined for a zero actual")
    )


def wape(y: Column, p: Column) -> Column:
    """Sum of absolute errors over sum of absolute actuals, a fraction."""
    total = F.sum(F.abs(y))
    return _guarded(
        y,
        p,
        F.try_divide(F.sum(F.abs(y - p)), total),
        (total == 0, "wape is undefined when the actuals sum to zero"),
    )


METRICS: dict[str, Metric] = {"mae": mae, "mape": mape, "rmse": rmse, "wape": wape}


def register(name: str, metric: Metric) -> None:
    """Add a metric; any ``(y, p) -> aggregate Column`` works, a pandas UDAF too."""
    METRICS[name] = metric


def resolve(names: Sequence[str]) -> dict[str, Metric]:
    if not names:
        raise ValueError("at least one metric is needed")
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metric(s): {unknown}")
    return {n: METRICS[n] for n in names}


def score(
    df: DataFrame,
    names: Sequence[str] = tuple(METRICS),
    by: Sequence[str] = (),
    actual: str = "y_true",
    predicted: str = "y_pred",
) -> DataFrame:
    """All metrics in one aggregate, overall or per group."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    aggs = [metric(y, p).alias(name) for name, metric in resolve(names).items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
