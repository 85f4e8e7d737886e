"""Rolling-origin folds and the backtest built on them.

Folds are arithmetic on the row position: which folds a row trains or tests is
computed from its index, so nothing is joined to find out. Training data is
never copied per fold: moments are summed once per stretch between two fold
edges and the folds combine those few sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as metric_fns
from tidemark.functions import timefn
from tidemark.operators import ordered, regress
from tidemark.operators.ordered import Running


class InfeasibleSplit(ValueError):
    """The series is too short for the split."""


class MissingHistory(ValueError):
    """A prediction row has no training row to look up."""


@dataclass(frozen=True)
class RollingOrigin:
    """Rolling-origin split over row positions 0..n-1."""

    min_train: int
    test_len: int
    step: int
    gap: int = 0
    fixed_window: bool = False

    def __post_init__(self) -> None:
        if min(self.min_train, self.test_len, self.step) < 1 or self.gap < 0:
            raise ValueError(f"invalid split {self}")

    def folds(self, n_rows: int) -> int:
        room = n_rows - self.test_len - self.min_train - self.gap
        if n_rows < 1 or room < 0:
            raise InfeasibleSplit(f"{self} does not fit {n_rows} rows")
        return room // self.step + 1

    def plan(self, spark, n_rows: int) -> DataFrame:
        """One row per fold with its half-open position ranges."""
        i = F.col("id")
        origin = i * self.step + self.min_train + self.gap
        end = i * self.step + self.min_train
        start = i * self.step if self.fixed_window else F.lit(0).cast("long")
        return spark.range(self.folds(n_rows)).select(
            i.alias("fold_index"),
            start.alias("train_start"),
            end.alias("train_end"),
            origin.alias("test_start"),
            (origin + self.test_len).alias("test_end"),
        )

    def test_folds(self, ix: Column, folds: int) -> Column:
        """Array of the folds that test this row; empty when there is none."""
        first_origin = self.min_train + self.gap
        low = F.greatest(
            F.lit(0).cast("long"), F.ceil((ix - first_origin - self.test_len + 1) / F.lit(self.step))
        )
        high = F.least(
            F.lit(folds - 1).cast("long"), F.floor((ix - first_origin) / F.lit(self.step))
        )
        return F.when(low <= high, F.sequence(low, high)).otherwise(
            F.array().cast("array<bigint>")
        )

    def train_cell(self, ix: Column) -> Column:
        """Stretch between two fold edges; every training range is a run of cells."""
        from_end = F.greatest(
            F.lit(0).cast("long"), F.floor((ix - self.min_train) / F.lit(self.step)) + 1
        )
        if not self.fixed_window:
            return from_end
        from_start = F.floor(ix / F.lit(self.step))
        return F.struct(from_start.alias("s"), from_end.alias("e"))


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


def test_rows(frame: DataFrame, split: RollingOrigin, folds: int, ix: str = "ix") -> DataFrame:
    """Rows of all test windows with ``fold_index`` and ``horizon_h``.

    A row is repeated only where test windows overlap (step < test_len).
    """
    spread = frame.select(
        "*", F.explode(split.test_folds(F.col(ix), folds)).alias("fold_index")
    )
    origin = F.col("fold_index") * split.step + split.min_train + split.gap
    return spread.withColumn("horizon_h", F.col(ix) - origin)


def train_rows(frame: DataFrame, split: RollingOrigin, folds: int, ix: str = "ix") -> DataFrame:
    """Rows x folds they train, for callers that need the rows themselves.

    Under expanding windows this repeats rows once per later fold; fits from
    moments do not use it.
    """
    i = F.col(ix)
    low = F.greatest(
        F.lit(0).cast("long"), F.floor((i - split.min_train) / F.lit(split.step)) + 1
    )
    high = F.lit(folds - 1).cast("long")
    if split.fixed_window:
        high = F.least(high, F.floor(i / F.lit(split.step)))
    members = F.when(low <= high, F.sequence(low, high)).otherwise(
        F.array().cast("array<bigint>")
    )
    return frame.select("*", F.explode(members).alias("fold_index"))


def fold_moments(
    frame: DataFrame,
    split: RollingOrigin,
    folds: int,
    features: Sequence[str],
    target: str,
    ix: str = "ix",
    intercept: bool = True,
) -> DataFrame:
    """Moments of every fold's training rows from one pass over the rows.

    Expanding: running sums over cells. Sliding: each cell adds to the few
    folds that contain it. Neither subtracts sums.
    """
    placed = frame.withColumn("cell", split.train_cell(F.col(ix)))
    cells = regress.moments(placed, features, target, ["cell"], intercept)
    if split.fixed_window:
        low = F.col("cell.e")
        high = F.least(F.lit(folds - 1).cast("long"), F.col("cell.s"))
        spread = cells.filter(low <= high).select(
            F.explode(F.sequence(low, high)).alias("fold_index"), "packed"
        )
        return regress.add_packed(spread, ["fold_index"])
    sums = ordered.running(
        regress.unpack(cells, ["cell"]),
        "cell",
        {"total": Running("sum", "value")},
        ["pos"],
        cut=ordered.width(1_000),
    )
    per_fold = sums.filter(F.col("cell") < folds).withColumnRenamed("cell", "fold_index")
    return regress.pack(per_fold, ["fold_index"], "total")


class Forecaster(Protocol):
    """A model the backtest can run: one call gives the predictions of all folds.

    ``frame`` has ``ix``, the time column, the target and the features. The
    answer has ``fold_index``, ``ix`` and ``y_pred``, one row per test row.
    """

    name: str

    def predict_folds(
        self, frame: DataFrame, split: RollingOrigin, folds: int, ts: str, target: str
    ) -> DataFrame: ...


@dataclass(frozen=True)
class LinearModel:
    """Ordinary least squares on given columns."""

    name: str
    features: tuple[str, ...]
    intercept: bool = True

    def design(self, frame: DataFrame, ts: str) -> tuple[DataFrame, Sequence[str]]:
        return frame, self.features

    def fit_folds(
        self, frame: DataFrame, split: RollingOrigin, folds: int, ts: str, target: str
    ) -> DataFrame:
        wide, features = self.design(frame, ts)
        sums = fold_moments(wide, split, folds, features, target, intercept=self.intercept)
        return regress.solve(sums, ["fold_index"], self.intercept)

    def predict_folds(
        self, frame: DataFrame, split: RollingOrigin, folds: int, ts: str, target: str
    ) -> DataFrame:
        wide, features = self.design(frame, ts)
        fits = self.fit_folds(frame, split, folds, ts, target)
        tests = test_rows(wide, split, folds)
        scored = regress.apply_fit(tests, fits, features, ["fold_index"], self.intercept)
        return scored.select("fold_index", "ix", "y_pred")


@dataclass(frozen=True)
class WeatherResponse(LinearModel):
    """Hinged temperature response with daily and weekly Fourier terms."""

    name: str = "weather-response"
    features: tuple[str, ...] = ()
    temperature: str = "temperature_2m"
    diurnal: int = 3
    weekly: int = 2
    t_heat: float = 15.5
    t_cool: float = 22.0

    def design(self, frame: DataFrame, ts: str) -> tuple[DataFrame, Sequence[str]]:
        return regress.weather_response_design(
            frame, self.temperature, ts, self.diurnal, self.weekly, self.t_heat, self.t_cool
        )


@dataclass(frozen=True)
class SeasonalNaive:
    """Repeat an earlier value: ``same_hour_yesterday``, ``same_hour_last_week`` or
    ``same_hour_same_weekday`` (latest training row of that weekday and hour, UTC)."""

    name: str
    strategy: str

    LAGS = {"same_hour_yesterday": 24, "same_hour_last_week": 168}

    def predict_folds(
        self, frame: DataFrame, split: RollingOrigin, folds: int, ts: str, target: str
    ) -> DataFrame:
        tests = test_rows(frame, split, folds).select("fold_index", "ix", ts)
        end = F.col("fold_index") * split.step + split.min_train
        start = end - split.min_train if split.fixed_window else F.lit(0)
        if self.strategy in self.LAGS:
            history = frame.select(
                timefn.shift_hours(ts, self.LAGS[self.strategy]).alias(ts),
                F.col("ix").alias("__src"),
                F.col(target).cast("double").alias("y_pred"),
            )
            found = tests.join(history, ts, "left")
            inside = (F.col("__src") < end) & (F.col("__src") >= start)
            return found.select(
                "fold_index", "ix", F.when(inside, F.col("y_pred")).alias("y_pred")
            )
        if self.strategy != "same_hour_same_weekday":
            raise ValueError(f"unknown strategy {self.strategy!r}")
        # Training ends before every test row, so the latest match at or before the
        # row is the latest match inside the training part.
        slots = {"dow": F.weekday(ts), "hod": F.hour(ts)}
        history = frame.withColumns(slots).select(
            "dow", "hod", F.col("ix").alias("at"), F.struct(
                F.col("ix").alias("src"), F.col(target).cast("double").alias("y")
            ).alias("hit"),
        )
        wanted = tests.withColumns(slots).select(
            "dow", "hod", (end - 1).alias("at"), "fold_index", "ix", start.alias("__start")
        )
        # Several rows of one slot may ask at the same position, so ask once per slot.
        asked = wanted.select("dow", "hod", "at").distinct()
        found = ordered.step_lookup(
            history, asked, "at", "hit", ["dow", "hod"], cut=ordered.width(10_000)
        )
        joined = wanted.join(found, ["dow", "hod", "at"], "left")
        inside = F.col("hit.src") >= F.col("__start")
        return joined.select(
            "fold_index", "ix", F.when(inside, F.col("hit.y")).alias("y_pred")
        )


def fixed_lag(
    df: DataFrame, hours: int, target: str, ts: str = "timestamp_utc", name: str = "y_pred"
) -> DataFrame:
    """y(t - lag) by an equality join on shifted time; null where there is no such row."""
    back = df.select(
        timefn.shift_hours(ts, hours).alias(ts), F.col(target).cast("double").alias(name)
    )
    return df.join(back, ts, "left")


def same_weekday(
    history: DataFrame, wanted: DataFrame, target: str, ts: str = "timestamp_utc"
) -> DataFrame:
    """Latest history value of the same weekday and hour (UTC) at or before each row."""
    slots = {"dow": F.weekday(ts), "hod": F.hour(ts)}
    return ordered.step_lookup(
        history.withColumns(slots).select("dow", "hod", ts, F.col(target).alias("y_pred")),
        wanted.withColumns(slots),
        ts,
        "y_pred",
        ["dow", "hod"],
    ).drop("dow", "hod")


def require_found(df: DataFrame, column: str = "y_pred") -> DataFrame:
    """Fail with the number of prediction rows that found no training row."""
    misses, total = df.agg(F.count_if(F.col(column).isNull()), F.count("*")).first()
    if misses:
        raise MissingHistory(f"{misses}/{total} prediction rows have no matching training row")
    return df


def predictions(
    model: Forecaster,
    frame: DataFrame,
    split: RollingOrigin,
    target: str,
    ts: str = "timestamp_utc",
    n_rows: int | None = None,
) -> DataFrame:
    """Long predictions of all folds.

    ``frame`` carries ``ix`` (``ordered.row_index``); stage it when it is
    costly, because the fit and the test side both read it. Every test row of
    every fold is there; ``y_pred`` is null where the model has no prediction.
    """
    folds = split.folds(count_rows(frame) if n_rows is None else n_rows)
    predicted = model.predict_folds(frame, split, folds, ts, target)
    tests = test_rows(frame, split, folds).select(
        "fold_index", "ix", "horizon_h", ts, F.col(target).cast("double").alias("y_true")
    )
    joined = tests.join(predicted, ["fold_index", "ix"], "left")
    spans = tests.groupBy("fold_index").agg(
        F.min(ts).alias("test_start"), F.max(ts).alias("test_end")
    )
    return joined.join(spans, "fold_index").select(
        "fold_index",
        "test_start",
        "test_end",
        "horizon_h",
        ts,
        "y_true",
        "y_pred",
        (F.col("y_true") - F.col("y_pred")).alias("error"),
    )


def fold_metrics(
    predicted: DataFrame,
    frame: DataFrame,
    split: RollingOrigin,
    names: Sequence[str] = ("mae", "mape", "rmse", "wape"),
    ts: str = "timestamp_utc",
) -> DataFrame:
    """Metrics per fold with the fold's edges, one row for every fold.

    A fold without any prediction, because its training rows give no fit, is an
    error that names it.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    lost = F.concat(F.lit("no prediction in fold "), F.col("fold_index").cast("string"))
    per_fold = predicted.groupBy("fold_index").agg(
        F.count(p).alias("__predicted"),
        F.min("test_start").alias("test_start"),
        F.max("test_end").alias("test_end"),
        *(m(y, p).alias(n) for n, m in metric_fns.resolve(names).items()),
    )
    start = F.when(F.col("__predicted") > 0, F.col("test_start")).otherwise(F.raise_error(lost))
    per_fold = per_fold.withColumn("test_start", start)
    offset = F.col("ix") + 1 - split.min_train
    ends = frame.filter((offset >= 0) & (F.pmod(offset, F.lit(split.step)) == 0)).select(
        F.floor(offset / F.lit(split.step)).alias("fold_index"), F.col(ts).alias("train_end")
    )
    return per_fold.join(ends, "fold_index").select(
        "fold_index", "train_end", "test_start", "test_end", *names
    )


def evaluate(
    model: Forecaster,
    frame: DataFrame,
    split: RollingOrigin,
    target: str,
    names: Sequence[str] = ("mae", "mape", "rmse", "wape"),
    ts: str = "timestamp_utc",
    n_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(metrics per fold, predictions) of one model."""
    predicted = predictions(model, frame, split, target, ts, n_rows)
    return fold_metrics(predicted, frame, split, names, ts), predicted


def across_folds(per_fold: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds, long form."""
    long = per_fold.select(
        F.explode(
            F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))
        ).alias("m")
    ).select("m.*")
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n_folds")
    )


def final_fit(fits: DataFrame) -> DataFrame:
    """Parameters of the last fold."""
    rest = [c for c in fits.columns if c != "fold_index"]
    return (
        fits.agg(F.max_by(F.struct("fold_index", *rest), "fold_index").alias("last")).select("last.*")
    )


def holdout_split(
    frame: DataFrame,
    start: Column,
    end: Column,
    chunk: int | None = 168,
    ts: str = "timestamp_utc",
) -> RollingOrigin:
    """Split that walks a holdout window in chunks; None makes it one fold."""
    if chunk is not None and chunk <= 0:
        raise ValueError(f"chunk must be positive or None, got {chunk}")
    t = F.col(ts)
    before, inside = frame.agg(
        F.count_if(t < start), F.count_if((t >= start) & (t <= end))
    ).first()
    if inside == 0:
        raise InfeasibleSplit("the holdout window selects no rows")
    if before == 0:
        raise InfeasibleSplit("no rows precede the holdout window")
    length = inside if chunk is None else min(chunk, inside)
    return RollingOrigin(before, length, length, 0, fixed_window=True)


def overlap_window(
    archive: DataFrame, start: Column, end: Column, ts: str = "timestamp_utc"
) -> DataFrame:
    """Complete archive rows inside [start, end]; no rows is an error."""
    return archive.dropna().filter((F.col(ts) >= start) & (F.col(ts) <= end))


def compare_with_benchmark(
    models: Mapping[str, Forecaster],
    frame: DataFrame,
    archive_hourly: DataFrame,
    split: RollingOrigin,
    target: str,
    names: Sequence[str] = ("mae", "mape", "rmse", "wape"),
    ts: str = "timestamp_utc",
    benchmark: str = "neso",
    n_rows: int | None = None,
) -> DataFrame:
    """Mean-over-folds metrics per model, and one row for the external forecast.

    The external row uses its own outturn over the whole span of the test
    windows; the model rows are means over all folds. An empty overlap fails in
    the metric (zero rows).
    """
    if not models:
        raise ValueError("at least one model is needed")
    rows = count_rows(frame) if n_rows is None else n_rows
    folds = split.folds(rows)
    tables = []
    for position, name in enumerate(sorted(models)):
        per_fold, _ = evaluate(models[name], frame, split, target, names, ts, rows)
        tables.append(
            per_fold.agg(*(F.avg(n).alias(n) for n in names)).select(
                F.lit(position).alias("position"), F.lit(name).alias("model"), *names
            )
        )
    tests = test_rows(frame, split, folds)
    span = tests.agg(F.struct(F.min(ts).alias("lo"), F.max(ts).alias("hi")).alias("b")).scalar()
    inside = archive_hourly.dropna().withColumn("__b", span).filter(
        (F.col(ts) >= F.col("__b.lo")) & (F.col(ts) <= F.col("__b.hi"))
    )
    external = metric_fns.score(
        inside, names, actual="demand_outturn_mw", predicted="demand_forecast_mw"
    ).select(F.lit(len(models)).alias("position"), F.lit(benchmark).alias("model"), *names)
    out = external
    for t in tables:
        out = out.unionByName(t)
    return out
